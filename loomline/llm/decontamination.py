"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the 13-word windows of the benchmark items (an item of fewer words is one
string). For each length of string a shift table over blocks of two words tells how far the search
may jump; where it may not, the block selects a bucket of test strings, and comparing words decides.
Common text holds none of the blocks, so the search reads about one word in twelve.

The strings go to the tasks in blocks of about ``max_block_bytes`` of benchmark text (a worker's tables take some 90 times
that). A larger benchmark is searched block after block: the driver and each worker hold one block at a time, and
what was found so far is written with the documents between two blocks. There is no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_rest, byte_texts, carried, id_and_text, keeps, rebatched, with_rest, written

#: Lower-cases A-Z; every other ASCII character that is no digit or letter becomes a space.
_WORD_BYTES = bytes(c if c > 127 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: Contamination rule: hit words are at least one in this many.
RULE = 20
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"


def search_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


class WordSearch:
    """Wu-Manber tables over words, one pair for each length of test string."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = 13) -> None:
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for name, text in items:
            words = search_words(text)
            size = min(width, len(words))
            for i in range(len(words) - size + 1) if size else ():
                by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).update(() if name is None else (name,))
        self.tables = []
        for size, strings in sorted(by_length.items()):
            block = min(2, size)
            shifts: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], list[str]]]] = {}
            for string, names in strings.items():
                for end in range(block, size + 1):
                    key = string[end - block : end]
                    shifts[key] = min(shifts.get(key, size), size - end)
                buckets.setdefault(string[-block:], []).append((list(string), sorted(names)))
            self.tables.append((size, block, shifts, buckets))

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Places (start, end) of all occurrences and the names of the items that have them."""
        places, found = [], set()
        for size, block, shifts, buckets in self.tables:
            far, at, n = size - block + 1, size, len(words)
            while at <= n:
                key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
                jump = shifts.get(key, far)
                if jump:
                    at += jump
                    continue
                here = words[at - size : at]
                for string, names in buckets[key]:
                    if string == here:
                        places.append((at - size, at))
                        found.update(names)
                at += 1
        return places, found


def _covered(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of the places as disjoint, ascending ranges."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, max_block_bytes: int) -> Iterator[tuple[bool, list[tuple[str | None, bytes]]]]:
    """The items in blocks of about ``max_block_bytes`` each, one at a time, and whether it is the last; items without text are left out."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("words")).filter("words is not null")
    size = items.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / max_block_bytes))
    of = F.pmod(F.xxhash64("item", "words"), F.lit(n))
    for k in range(n):
        yield k == n - 1, [(r.item, r.words.encode()) for r in items.filter(of == k).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, max_block_bytes: int = 2 << 20, carry: bool = False) -> DataFrame:
    """One row per input row: words, hit words, items found and whether the text is contaminated.

    A document word inside any occurrence of a test string is hit; ``contaminated`` when there is a
    hit and hits are at least a twentieth of the words. Null and empty texts have no words and are
    clean. Items without words find nothing; the windows of an item without id hit words, but it has no name to count or list; equal items are all named. Repeated rows are
    judged one by one. An empty benchmark hits nothing. Other columns are not read; with ``carry`` the
    text and a struct ``rest`` of them follow.
    """
    spark = docs.sparkSession
    out = id_and_text(docs, id_col, text_col, F.lit(None).cast("binary").alias("ranges"), F.lit(None).cast("array<string>").alias("items"), *(carried(docs, text_col) if carry else ()))
    for last, block in benchmark_blocks(benchmark, item_col, item_text_col, max_block_bytes):
        tables = spark.sparkContext.broadcast((uuid.uuid4().hex, block, width))
        if last:
            return out.mapInArrow(_scan(tables, last), with_rest(RESULT, out))
        out = written(out.mapInArrow(_scan(tables, last), out.schema), "searched")
        tables.destroy()


#: The tables that this worker built last, by the block's name.
_built: dict[str, WordSearch] = {}
keeps("decontamination", _built.clear)


def _search(name: str, items: list[tuple[str | None, bytes]], width: int) -> WordSearch:
    if name not in _built:
        _built.clear()
        _built[name] = WordSearch(items, width)
    return _built[name]


def _scan(tables, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(*tables.value)
        for batch in rebatched(batches, "text", keeper="decontamination"):
            rows = []
            for text, ranges, items in zip(byte_texts(batch, "text"), batch.column("ranges").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = search_words(text)
                places, found = search(words)
                if ranges:
                    places += [tuple(x) for x in np.frombuffer(ranges, np.int64).reshape(-1, 2).tolist()]
                rows.append((len(words), _covered(places), sorted(found.union(items or ()))))
            yield add_rest(_result(batch, rows), batch) if last else add_rest(_carried(batch, rows), batch, ("rest",))

    return run


def _carried(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    ranges = [np.array(r, np.int64).tobytes() if r else None for _, r, _ in rows]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(ranges, pa.binary()), pa.array([x for _, _, x in rows], pa.list_(pa.string()))], names=["doc_id", "text", "ranges", "items"])


def _result(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    n_words = [n for n, _, _ in rows]
    n_hit = [sum(e - s for s, e in r) for _, r, _ in rows]
    items = [x for _, _, x in rows]
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    verdicts = [h > 0 and RULE * h >= n for n, h in zip(n_words, n_hit, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(digests, pa.string()), pa.array(verdicts, pa.bool_()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])
