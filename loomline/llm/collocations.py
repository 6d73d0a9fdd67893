"""Phrase collocation mining by marginalising the longest windows.

Each word occurrence leads one window: the columns w1 to w4 are the word and those that follow it in its piece, padded where
the piece ends. Every phrase of up to four words that starts there is a prefix of that window, so only windows are counted, and a
Spark ROLLUP over (lang, w1, w2, w3, w4) sums them to all shorter phrases and to the words of a language; no phrase length
is exploded by itself.

A chunk's equal windows are one entry, sent with the chunk's own words as numbers (``_packed``). Windows meet by their first word. A
word that leads more than a part of all windows is met by its first two words, and such a pair by all four; which these are is
counted beforehand over all texts (``frequent_leads``). Where all windows of a prefix are in one place and sum up to less than
``least``, no phrase with that prefix can be a candidate nor a part of one: its words are padded before the ROLLUP, whose
sums for the remaining phrases stay exact. Scores are divided as decimals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, mixed, rebatched, written

LONGEST = 4
#: Bytes of text that are counted together before the shuffle, and those of a group after it, about.
CHUNK_BYTES, GROUP_BYTES = 16 << 20, 8 << 20
#: A lead is frequent from 1 / (SHARES * groups) of all windows on, but not below 1 / MOST: so at most 2 * MOST are broadcast.
SHARES, MOST = 4, 1 << 20
#: Salts of the last ranking but one.
SALTS = 64
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WINDOWS = "lang string, w1 string, w2 string, w3 string, w4 string, n bigint"


def lead_windows(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and its windows: a row for each occurrence, numbers of words from 1 on, 0 as padding."""
    text = text.translate(_TABLE)
    words = text.split()
    if not words:
        return [], np.empty((0, LONGEST), np.int64)
    raw = np.frombuffer(text, np.uint8)
    gap = (raw == 32) | (raw == 10)
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    piece = np.cumsum(raw == 10)[starts]
    number = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out = np.zeros((len(ids), LONGEST), np.int64)
    for k in range(min(LONGEST, len(ids))):
        n = len(ids) - k
        out[:n, k] = np.where(piece[k:] == piece[:n], ids[k:], 0)
    return list(number), out


def summed(windows: np.ndarray, n: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different windows in ascending order of their numbers (below ``size``), and how often each occurs (``n`` times a row, or once)."""
    if not len(windows):
        return windows, np.empty(0, np.int64)
    key = windows[:, 0]
    for k in range(1, LONGEST):
        if size ** (k + 1) >= 1 << 62:  # numbers for the prefixes, else they pass 63 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + windows[:, k]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]])))
    total = np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first)
    return windows[order[first]], total


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language in a chunk, end to end; no piece crosses a text."""
    of: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), byte_texts(batch, "text"), strict=True):
        of.setdefault(lang, []).append(text)
    for lang in sorted(of):
        yield lang, b"\n".join(of[lang])


def frequent_leads(texts: DataFrame, groups: int) -> tuple[dict[str, set[bytes]], dict[str, set[tuple[bytes, bytes]]]]:
    """Words and pairs that lead more than ``1 / (SHARES * groups)`` of all windows, by language (and some that lead half as many).

    A chunk names those that lead half that share of its own windows, so one of that share in all texts is named by enough chunks; at most two per share remain.
    """
    share = max(1 / MOST, 1 / (SHARES * groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            own = [(lang, *lead_windows(text)) for lang, text in by_language(batch)]
            all_windows = sum(len(w) for _, _, w in own)
            rows: list[tuple[str | None, bytes | None, bytes | None, int]] = [(None, None, None, all_windows)]
            for lang, words, windows in own:
                size = len(words) + 1
                times = np.bincount(windows[:, 0], minlength=size)
                often = times >= max(2, all_windows * share / 2)
                rows += [(lang, words[i - 1], None, int(times[i])) for i in np.flatnonzero(often)]
                led = windows[often[windows[:, 0]]]
                pairs, n = np.unique(led[:, 0] * size + led[:, 1], return_counts=True)
                for pair, k in zip(pairs.tolist(), n.tolist(), strict=True):
                    if k >= max(2, all_windows * share / 2):
                        a, b = divmod(pair, size)
                        rows.append((lang, words[a - 1], words[b - 1] if b else b"", k))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["lang", "w1", "w2", "n"])

    named = written(texts.mapInArrow(run, "lang string, w1 binary, w2 binary, n bigint").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")), "leads")
    every = named.filter("lang is null").agg(F.sum("n")).first()[0] or 0
    words: dict[str, set[bytes]] = {}
    pairs: dict[str, set[tuple[bytes, bytes]]] = {}
    for r in named.filter(F.col("lang").isNotNull() & (F.col("n") >= every * share / 2)).collect():
        if r["w2"] is None:
            words.setdefault(r["lang"], set()).add(bytes(r["w1"]))
        else:
            pairs.setdefault(r["lang"], set()).add((bytes(r["w1"]), bytes(r["w2"])))
    return words, pairs


def _packed(words: list[bytes], windows: np.ndarray, n: np.ndarray) -> bytes:
    """Windows with the words they use, compressed."""
    used, number = np.unique(windows, return_inverse=True)
    used = used[used > 0]
    number = number.reshape(windows.shape) + (0 if (windows == 0).any() else 1)
    text = b"\n".join(words[i - 1] for i in used.tolist())
    head = np.array([len(windows), len(text)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + text + number.T.astype("<u4").tobytes() + n.astype("<u8").tobytes())


def _unpacked(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, size = np.frombuffer(raw, "<u8", 2).tolist()
    windows = np.frombuffer(raw, "<u4", n * LONGEST, 16 + size).reshape(LONGEST, n).T.astype(np.int64)
    return raw[16 : 16 + size].split(b"\n"), windows, np.frombuffer(raw, "<u8", n, 16 + size + 4 * n * LONGEST).astype(np.int64)


def _dealt(words: list[bytes], windows: np.ndarray, groups: int, leads: set[bytes], pairs: set[tuple[bytes, bytes]]) -> np.ndarray:
    """The group of each window; from ``groups`` on all windows of its pair are there, from twice as much on no more than the window."""
    hashes = np.array([0, *(xxhash.xxh3_64_intdigest(w) for w in words)], np.uint64)
    size = len(words) + 1
    level = np.array([0, *(w in leads for w in words)], np.int64)[windows[:, 0]]
    number = {w: i for i, w in enumerate(words, 1)} | {b"": 0} if pairs else {}
    spread = [number[a] * size + number[b] for a, b in pairs if a in number and b in number]
    level[np.isin(windows[:, 0] * size + windows[:, 1], spread)] = 2
    key = hashes[windows[:, 0]]
    key = np.where(level > 0, key * _ODD + hashes[windows[:, 1]], key)
    key = np.where(level > 1, (key * _ODD + hashes[windows[:, 2]]) * _ODD + hashes[windows[:, 3]], key)
    return (mixed(mixed(key)) % np.uint64(groups)).astype(np.int64) + level * groups


def _marginalised(windows: np.ndarray, n: np.ndarray, size: int, whole: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows, ascending, with words padded that no prefix of at least ``least`` reaches; prefixes of ``whole`` words and more are complete here (0: the window only)."""
    out = windows.copy()
    changed = np.zeros(len(windows), bool)
    for k in range(1, LONGEST):
        changed |= np.concatenate(([True], windows[1:, k - 1] != windows[:-1, k - 1]))
        if k >= whole:
            first = np.flatnonzero(changed)
            total = np.add.reduceat(n, first)
            out[np.repeat(total, np.diff(np.append(first, len(n)))) < least, k - 1 :] = 0
    out[n < least, LONGEST - 1] = 0
    return summed(out, n, size)


def counted_windows(texts: DataFrame, groups: int, least: int) -> DataFrame:
    """(lang, w1 to w4, n): windows of ``texts`` (lang, text), marginalised; several rows of a window are to be added up."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent_leads(texts, groups))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads, pairs = shared.value
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            for lang, text in by_language(batch):
                words, windows = lead_windows(text)
                if not words:
                    continue
                windows, n = summed(windows, None, len(words) + 1)
                group = _dealt(words, windows, groups, leads.get(lang, set()), pairs.get(lang, set()))
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0)))
                rows = [_packed(words, windows[own], n[own]) for own in np.split(order, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(group[order[first]]), pa.array(rows, pa.binary())], names=["lang", "grp", "windows"])

    def count(table: pa.Table) -> pa.Table:
        lang, group = table.column("lang")[0].as_py(), table.column("grp")[0].as_py()
        number: dict[bytes, int] = {}
        rows, times = [], []
        for data in table.column("windows"):
            words, windows, n = _unpacked(data.as_py())
            own = np.array([0, *(number.setdefault(w, len(number) + 1) for w in words)], np.int64)
            rows.append(own[windows])
            times.append(n)
        size = len(number) + 1
        windows, n = summed(np.concatenate(rows), np.concatenate(times), size)
        level = group // groups
        if level < 2:
            windows, n = _marginalised(windows, n, size, level + 1, least)
        else:
            windows, n = summed(np.where((np.arange(LONGEST) < LONGEST - 1) | (n >= least)[:, None], windows, 0), n, size)
        names = pa.array([None, *number], pa.binary()).cast(pa.string())
        columns = [names.take(pa.array(windows[:, k])) for k in range(LONGEST)]
        one = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64)))
        return pa.table([one, *columns, pa.array(n)], names=["lang", "w1", "w2", "w3", "w4", "n"])

    return texts.mapInArrow(deal, "lang string, grp bigint, windows binary").groupBy("lang", "grp").applyInArrow(count, _WINDOWS)


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """(lang, words, f): phrases of at least ``least`` occurrences, and the words of a language under the empty phrase."""
    columns = ["w1", "w2", "w3", "w4"]
    sums = windows.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    rows = sums.filter(F.col("level") <= 15).withColumn("size", F.lit(4) - F.length(F.regexp_replace(F.bin("level"), "0", "")))
    phrase = F.array(*columns)
    whole = rows.withColumn("words", F.slice(phrase, F.lit(1), F.col("size"))).filter("size = 0 or (f >= %d and words[size - 1] is not null)" % least)
    return whole.select("lang", "words", "f")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, covered: int = 80, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases of two to four words by the score of their weakest cut.

    Phrases of at least ``least`` occurrences within pieces are candidates; one that lies in a longer candidate with at least
    ``covered`` percent of its occurrences is dropped. A null text has no words, a null lang is ``und``; repeated rows count
    again. Equal scores are ranked by the occurrences, then by the phrase's UTF-8 bytes. A language without candidates and an
    empty table give no rows; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(math.ceil(size / GROUP_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = written(phrase_counts(counted_windows(texts, groups, least), least), "phrases")
    phrases = counts.filter("size(words) > 0").withColumn("phrase", F.concat_ws(" ", "words"))
    candidates = phrases.filter("size(words) > 1").withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.concat_ws(" ", F.expr("slice(words, 1, k)"))).withColumn("right", F.concat_ws(" ", F.expr("slice(words, k + 1, size(words) - k)")))
    part = lambda name, times: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(times))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("exact_a", _exact("a")).withColumn("whole", _exact("l") + _exact("r"))
    cuts = cuts.withColumn("score", F.expr("(2000000BD * exact_a) div whole"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("weakest")).select("lang", "phrase", "weakest.*")
    inner = candidates.filter("size(words) > 2").select("lang", F.col("a").alias("longer"), "words", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("size"))
    inner = inner.select("lang", "longer", "words", "size", F.explode(F.expr("sequence(1, size(words) - size + 1)")).alias("at")).withColumn("phrase", F.concat_ws(" ", F.expr("slice(words, at, size)")))
    holders = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(holders, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * covered))
    best = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")
    few = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", best("salt")).filter(F.col("rank") <= first)
    ranked = few.withColumn("rank", best()).filter(F.col("rank") <= first)
    total = counts.filter("size(words) = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
