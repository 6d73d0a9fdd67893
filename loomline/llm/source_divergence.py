"""Source divergence audit: how the terms of each source differ from those of its language and of the other sources.

A document is turned into terms by one ``bytes.translate`` (A-Z lower-cased, separators blanked) and ``bytes.split``; its
``Counter`` gives the frequencies, and its keys the documents that hold a term. A task adds these up by (lang, source, term)
and hands on what it has whenever it holds ``HELD`` terms, so a source with a third of all rows is a row for each term and
hand-over. Rows meet by (lang, term): there the documents of a term are counted and rare terms go. What stays is sparse
(only the sources that use a term), and so are the sums: terms that neither of two sources uses are added as a product.
Distances between sources are summed over shards of the terms and tiles of ``TILE`` sources, as small dense matrices.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, rebatched, written

#: Terms that a task holds before it hands its sums on.
HELD = 400_000
#: Sources of a tile, and rows of a shard of terms, about.
TILE, SHARD_ROWS = 128, 100_000
#: Terms in a dense matrix at a time.
BLOCK = 2048
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, docs bigint, times bigint"
_SUMS = "lang string, a int, b int, value bigint"


def document_terms(text: bytes) -> Counter[bytes]:
    """The terms of a text and how often each occurs."""
    return Counter(text.translate(_TABLE).split())


class Held:
    """Sums of one task by (lang, source) and term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[dict[bytes, int], Counter[bytes]]] = {}
        self.size = 0

    def add(self, group: tuple[str, str], terms: Counter[bytes]) -> None:
        times, docs = self.groups.setdefault(group, ({}, Counter()))
        before, seen = len(times), times.get
        for term, n in terms.items():
            times[term] = seen(term, 0) + n
        docs.update(terms.keys())
        self.size += len(times) - before

    def hand_over(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in self.groups.items():
            if times:
                n = len(times)
                one = lambda x, n=n: pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int32)))
                columns = [one(lang), one(source), pa.array(list(times), pa.binary()).cast(pa.string()), pa.array([docs[t] for t in times], pa.int64()), pa.array(list(times.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "times"])
        self.groups.clear()
        self.size = 0


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Partial sums (lang, source, term, docs, times) of ``docs`` (lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Held()
        for batch in rebatched(batches, "text"):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), byte_texts(batch, "text"), strict=True):
                sums.add((lang, source), document_terms(text))
                if sums.size > held:
                    yield from sums.hand_over()
        yield from sums.hand_over()

    return docs.mapInArrow(run, _COUNTS)


def smoothed(count: str, total: str, terms: str) -> Column:
    """1 + floor(1000000000 * (count + 5) / (total + 5 * terms)) in decimals; 0 without terms."""
    share = f"(1000000000BD * (cast({count} as decimal(20,0)) + 5BD)) div (cast({total} as decimal(20,0)) + 5BD * cast({terms} as decimal(20,0)))"
    return F.expr(f"case when {terms} > 0 then 1 + {share} else 0L end").cast("bigint")


def _tile_sums(table: pa.Table, tile: int, block: int) -> pa.Table:
    """Of two tiles of sources and one shard of terms: sums of |p - q| for each pair, less what the pair would have if neither used the terms."""
    lang, left, right = (table.column(c)[0].as_py() for c in ("lang", "left", "right"))
    source, p = table.column("idx").to_numpy().astype(np.int64), table.column("p").to_numpy().astype(np.int64)
    term = table.column("term").combine_chunks()
    head = term.is_null().to_numpy(zero_copy_only=False)
    ids = np.sort(source[head])
    base = p[head][np.argsort(source[head], kind="stable")]
    code = term.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    column, code, p = np.searchsorted(ids, source[~head]), code[~head].astype(np.int64), p[~head]
    order = np.argsort(code, kind="stable")
    column, code, p = column[order], code[order], p[order]
    a, b = np.flatnonzero(ids // tile == left), np.flatnonzero(ids // tile == right)
    sums = np.zeros((len(a), len(b)), np.int64)
    n = int(code[-1]) + 1 if len(code) else 0
    for at in range(0, n, block):
        lo, hi = np.searchsorted(code, (at, at + block))
        dense = np.tile(base, (min(block, n - at), 1))
        dense[code[lo:hi] - at, column[lo:hi]] = p[lo:hi]
        other = dense[:, b]
        for k, i in enumerate(a):
            sums[k] += np.abs(dense[:, i, None] - other).sum(0)
    sums -= n * np.abs(base[a][:, None] - base[b])
    x, y, value = np.repeat(ids[a], len(b)), np.tile(ids[b], len(a)), sums.ravel()
    if left != right:
        x, y, value = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([value, value])
    x, y, value = (v[x != y] for v in (x, y, value))
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "a": pa.array(x, pa.int32()), "b": pa.array(y, pa.int32()), "value": value})


def source_distances(shares: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language, |p - q| summed over all kept terms.

    ``shares`` has (lang, idx, term, p) of the terms that a source uses, ``groups`` (lang, source, idx, absent, n_sources, n_terms), where
    ``absent`` is p of a term that the source does not use. Every shard gets the sources of its tiles as rows without a term.
    """
    tile, block = TILE, BLOCK
    tiles = lambda sources: F.expr(f"sequence(0, cast(({sources} - 1) div {tile} as int))")
    own = F.expr(f"cast(idx div {tile} as int)")
    spread = lambda df: df.withColumn("tile", F.explode(tiles("n_sources"))).select("lang", F.least("tile", own).alias("left"), F.greatest("tile", own).alias("right"), "shard", "idx", "term", "p")
    heads = spread(groups.select("lang", "n_sources", "idx", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")))
    rows = spread(shares.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")))
    sums = heads.unionByName(rows).groupBy("lang", "left", "right", "shard").applyInArrow(lambda table: _tile_sums(table, tile, block), _SUMS)
    summed = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    side = lambda which: groups.select("lang", F.col("idx").alias(which), F.col("source").alias(f"{which}_source"), F.col("absent").alias(f"{which}_absent"), F.col("n_terms").alias(f"{which}_terms"))
    named = summed.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    return named.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), (F.col("value") + F.col("a_terms") * F.abs(F.col("a_absent") - F.col("b_absent"))).alias("value"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, most: int = 50, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source to the others, and its ``most`` most overused terms.

    Terms of at least ``least`` documents of a language count; repeated rows are documents of their own. A null text has no
    terms; a null lang or source is the empty one. A source without terms has distances, too (to what it would have by smoothing alone), and no
    terms; a language without kept terms has distances of 0. Equal values are ranked by the item's UTF-8 bytes. An empty
    table gives no rows; other columns are not read. Sums are integers of 64 bits, shares are divided as decimals.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    texts = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    by_term = Window.partitionBy("lang", "term")
    together = term_counts(texts, held).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    counted = together.withColumn("holders", F.sum("docs").over(by_term)).withColumn("lang_times", F.sum("times").over(by_term)).withColumn("first", F.row_number().over(by_term.orderBy("source")) == 1)
    kept = written(counted.filter(F.col("holders") >= least).select("lang", "source", "term", "times", "lang_times", "first"), "terms")
    by_lang = kept.filter("first").groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_times").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    numbered = Window.partitionBy("lang")
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["total", "n_terms", "lang_total"])
    groups = groups.withColumn("idx", F.row_number().over(numbered.orderBy("source")).cast("int") - 1).withColumn("n_sources", F.count("*").over(numbered))
    groups = written(groups.withColumn("absent", smoothed("0", "total", "n_terms")), "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", smoothed("times", "total", "n_terms"))
    shards = max(1, math.ceil(kept.count() / SHARD_ROWS))
    order = lambda *keys: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *keys)).cast("int")
    pairs = source_distances(shares, groups, shards).withColumn("rank", order("item"))
    over = shares.withColumn("value", F.col("p") - smoothed("lang_times", "lang_total", "n_terms")).filter("times > 0 and value > 0")
    over = over.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", order("item")).filter(F.col("rank") <= most)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(over, "term"))
