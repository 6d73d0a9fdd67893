"""Substring dedup over prefix-partitioned suffix trees of words.

A census counts the suffixes (word positions with a whole window after them) by their first three
words, coded in 16 ordered bits. Neighbouring codes are put together into groups of about
``GROUP_SUFFIXES``: a rare first word shares a group with others, a common one is told apart by its
second and third, and a code that is still too large by the rest of its window, into as many groups as that takes. So
the prefixes have the length that memory asks for. Each group is one subtree. Its suffixes are sorted; those that
agree on all words of a window hang on an internal node of that depth, whose leaves name the documents. A node with
leaves of several documents is a repeat; every
leaf of a document larger than the smallest is answered with that node. Consecutive answered nodes
of a document are its maximal repeats, whose words are removed.

Edges carry 64-bit hashes of words, not words, and end at window depth: with its words a suffix is about 85 bytes, and the
suffixes that repeat are a quarter of all, so words on the edges would alone take five times the input in shuffle files. A
suffix is told apart by the hash of its window and by its prefix group together.

Within a chunk equal windows are one suffix before the shuffle, so a passage of a third of all
documents costs a suffix for each chunk, not for each document; what is decided there goes past the subtrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import WordHasher, byte_texts, id_and_text, mixed, rebatched, window_hashes

CODE_BITS = 16
#: Suffixes for each subtree, and bytes of text for each task that rewrites documents, about.
GROUP_SUFFIXES = 1_000_000
BUCKET_BYTES = 12 << 20
CHUNK_BYTES = 6 << 20
_SUFFIX, _REPEAT = 0, 1
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, text string, repeats array<struct<start:int,end:int>>"


def _codes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Prefix codes of the first ``n`` suffixes: 8 bits of the first word, 4 of each of the next two."""
    first, second, third = (hashes[i : i + n] >> np.uint64(s) for i, s in ((0, 56), (1, 60), (2, 60)))
    return ((first << np.uint64(8)) | (second << np.uint64(4)) | third).astype(np.int64)


def _suffixes(batch: pa.RecordBatch, window: int, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, prefix code and window hash of each suffix of a chunk, documents ascending."""
    ids = batch.column("doc_id").to_pylist()
    texts = byte_texts(batch, "text")
    owners, codes, windows = [], [], []
    for i in sorted((i for i in range(len(ids)) if ids[i] is not None), key=ids.__getitem__):
        words = texts[i].split()
        n = len(words) - window + 1
        if n > 0:
            hashes = hasher(words)
            owners.append(np.full(n, ids[i], np.int64))
            codes.append(_codes(hashes, n))
            windows.append(window_hashes(hashes, window))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(codes), np.concatenate(windows)


def prefix_census(texts: DataFrame, window: int) -> np.ndarray:
    """Suffixes of the whole corpus by prefix code; the driver gets ``2**CODE_BITS`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hasher = np.zeros(1 << CODE_BITS, np.int64), WordHasher()
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            for text in byte_texts(batch, "text"):
                words = text.split()
                n = len(words) - window + 1
                if n > 0:
                    np.add.at(counts, _codes(hasher(words), n), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["code", "n"])

    rows = texts.filter("doc_id is not null").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << CODE_BITS, np.int64)
    out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def prefix_groups(census: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """First group of each code, and into how many groups its windows are split."""
    first, parts = np.zeros(len(census), np.int64), np.ones(len(census), np.int64)
    group, filled = 0, 0
    for code, n in enumerate(census.tolist()):
        if filled and filled + n > limit:
            group, filled = group + 1, 0
        first[code], parts[code] = group, max(1, math.ceil(n / limit))
        filled += n
        if parts[code] > 1:
            group, filled = group + int(parts[code]), 0
    return first, parts


def _folded(ids: np.ndarray) -> np.ndarray:
    x = ids.view(np.uint64)
    return (x ^ (x >> np.uint64(21)) ^ (x >> np.uint64(42))).view(np.int64)


def _bucket(doc_id: Column, text: Column, buckets: int) -> Column:
    """The same of a column as ``_folded(ids) % buckets``; rows without id go by their text."""
    folded = doc_id.bitwiseXOR(F.shiftrightunsigned(doc_id, 21)).bitwiseXOR(F.shiftrightunsigned(doc_id, 42))
    return F.pmod(F.coalesce(folded, F.xxhash64(text)), F.lit(buckets)).cast("int")


def next_prime(n: int) -> int:
    """The least prime of at least ``n``: ids in steps meet all buckets."""
    while n < 2 or any(n % i == 0 for i in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def repeated_windows(texts: DataFrame, window: int, census: np.ndarray, buckets: int) -> DataFrame:
    """Packed (document, window hash) pairs to remove, by bucket of the document's id."""
    first, parts = prefix_groups(census, GROUP_SUFFIXES)
    past = int(first[-1] + parts[-1])  # groups from here on are buckets
    plan = texts.sparkSession.sparkContext.broadcast((first.astype(np.int32), parts.astype(np.int32)))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = plan.value
        hasher = WordHasher()
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            owners, codes, windows = _suffixes(batch, window, hasher)
            if not len(owners):
                continue
            groups = first[codes] + (mixed(windows) % parts[codes].astype(np.uint64)).astype(np.int64)
            order, number = packed.classes(windows)
            lead = order[np.flatnonzero(np.diff(number, prepend=-1))]  # the smallest document of each window
            repeat = order[owners[order] > owners[lead][number]]
            lead.sort()
            yield packed.pack(groups[lead], owners[lead], windows[lead], _SUFFIX)
            if len(repeat):
                repeat.sort()
                yield packed.pack(past + _folded(owners[repeat]) % buckets, owners[repeat], windows[repeat], _REPEAT)

    def subtree(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        if group >= past:
            return table.set_column(0, "grp", pa.array(np.full(table.num_rows, group - past, np.int32)))
        owners, windows = packed.unpack(table, _SUFFIX)
        order = np.lexsort((owners, windows))
        owners, windows = owners[order], windows[order]
        node = np.cumsum(np.concatenate(([True], windows[1:] != windows[:-1]))) - 1 if len(windows) else np.empty(0, np.int64)
        least = owners[np.flatnonzero(np.diff(node, prepend=-1))]
        repeat = owners > least[node] if len(node) else np.empty(0, bool)
        docs, hashes = owners[repeat], windows[repeat]
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
        return pa.Table.from_batches([packed.pack(_folded(docs) % buckets, docs, hashes, _REPEAT)]) if len(docs) else packed.empty()

    return texts.mapInArrow(suffixes, packed.SCHEMA).groupBy("grp").applyInArrow(subtree, packed.SCHEMA)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept text (words joined by a space) and removed word ranges of each row.

    A word goes when a window that covers it also starts in a document with a smaller id; windows are
    judged on the input. Null and empty texts have no words; texts under a window lose none. Rows
    with the same id are one document for this: they do not repeat each other, and each is rewritten.
    Rows without id neither lose words nor count. An empty table gives no rows.
    """
    texts = id_and_text(docs, id_col, text_col)
    census = prefix_census(texts, window)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = next_prime(max(math.ceil(size / BUCKET_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    repeats = repeated_windows(texts, window, census, buckets)
    parts = texts.withColumn("grp", _bucket(F.col("doc_id").cast("bigint"), F.col("text"), buckets))

    def rewrite(table: pa.Table, marks: pa.Table) -> pa.Table:
        owners, windows = packed.unpack(marks, _REPEAT)
        order = np.argsort(owners, kind="stable")
        owners, windows = owners[order], windows[order]
        hasher, rows = WordHasher(), []
        for batch in table.combine_chunks().to_batches():
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch, "text"), strict=True):
                words = text.split()
                a, b = np.searchsorted(owners, [doc_id, doc_id + 1]) if doc_id is not None else (0, 0)
                if a == b or len(words) < window:
                    rows.append((doc_id, len(words), 0, b" ".join(words), []))
                    continue
                hit = np.flatnonzero(np.isin(window_hashes(hasher(words), window), windows[a:b]))
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept), [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        arrays[3] = arrays[3].cast(pa.string())
        return pa.Table.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "text", "repeats"])

    return parts.groupBy("grp").cogroup(repeats.groupBy("grp")).applyInArrow(rewrite, RESULT)
