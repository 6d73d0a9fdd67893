"""WARC archives of pages, and their capture index by an external merge.

Writing: a payload digest groups equal payloads; the page with the largest id is a ``response``
record, the others are ``revisit`` records that refer to it. Records are written through Spark's
text sink as gzipped WARC/1.1 files. Reading splits at a header line that names the run, whose random
id no earlier payload can hold, and checks each payload against its Content-Length and digest.

Index: each file of index entries is a run, sorted by URL key and capture time where it was made.
The order is cut into ranges that fit into memory, at places taken from a sample of the runs. A task that reads a run cuts it at
these places and sends each stretch, still sorted, to its range in blocks; a range puts the stretches of all runs together by a k-way
loser tree, without sorting again. The ranges in turn hold the whole capture
history in order. A page captured very often spreads over ranges, as time and id are in the key.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

_CRLF = "\r\n"
_BASE32_OF = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: Index entries that one merging task takes, about.
RANGE_ROWS = 250_000
INDEX = "url_key string, capture_ts timestamp, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, as WARC digests have it."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *_BASE32_OF)


def url_key(url: Column) -> Column:
    """Host parts reversed and comma-joined, then path and query, lower-case: neighbours sort together."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), r"^www\d*\.|:\d+$", "")
    path = F.lower(F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Only digests held by two pages or more meet the payloads again, in a join that adaptive
    execution broadcasts if it is small and splits if one digest is hot.
    """
    known = pages.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    held = known.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first_page"), F.count("*").alias("holders")).filter("holders > 1").drop("holders")
    other = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") != F.col("first_page"))
    return (
        known.join(held, "payload_digest", "left")
        .withColumn("record_type", F.when(other, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(other, F.col("first_page")))
        .drop("first_page")
    )


def _record(run: str) -> Column:
    """The text of a record up to the blank lines that end it; the text sink adds those."""
    stamp = F.date_format("capture_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    is_response = F.col("record_type") == "response"
    block = F.when(is_response, F.col("payload")).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}X-Archive-Run: {run}{_CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", stamp),
        F.coalesce(line("WARC-Target-URI", F.translate("url", "\r\n", "")), F.lit("")),
        F.when(F.col("url").rlike(r"[\r\n]"), line("X-Target-Base64", F.base64(F.col("url").cast("binary")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(is_response, "").otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_CRLF),
        block,
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", capture_ts: Column | None = None) -> str:
    """Write one record for each row to WARC files under ``path``; returns the run id for reading.

    A null payload is empty. Without ``capture_ts`` pages count as captured one a second by id, within a bounded span of time.
    """
    run = uuid.uuid4().hex
    own = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"), F.coalesce(*([capture_ts] if capture_ts is not None else []), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(0)), F.lit(1_000_000_000)))).alias("capture_ts"))
    with_revisits(own, least_bytes).select(_record(run).alias("value")).write.option("lineSep", _CRLF * 2).option("compression", "gzip").text(path)
    return run


def read_archives(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The records of a run: page id, type, url, time, digest, bytes of the payload, block and whether it is whole."""
    lines = spark.read.option("lineSep", f"{_CRLF * 2}WARC/1.1{_CRLF}X-Archive-Run: {run}{_CRLF}").text(path)
    ends = F.instr("value", _CRLF * 2)
    head = F.concat(F.lit(_CRLF), F.col("value").substr(F.lit(1), ends + 1))
    field = lambda name: F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1)
    records = lines.filter(ends > 0).select(head.alias("head"), F.col("value").substr(ends + 4, F.length("value")).alias("rest"))
    out = records.select(
        F.expr("try_cast(nullif(regexp_extract(head, 'WARC-Record-ID: <urn:page:([^>]*)>', 1), '') as bigint)").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        F.when(F.instr("head", "\r\nX-Target-Base64: ") > 0, F.unbase64(field("X-Target-Base64")).cast("string")).when(F.instr("head", "\r\nWARC-Target-URI: ") > 0, field("WARC-Target-URI")).alias("url"),
        F.to_timestamp(field("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("capture_ts"),
        F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]*)", 1).alias("payload_digest"),
        field("X-Payload-Length").cast("bigint").alias("payload_bytes"),
        F.expr("try_cast(nullif(regexp_extract(head, 'WARC-Refers-To: <urn:page:([^>]*)>', 1), '') as bigint)").alias("refers_to"),
        field("Content-Length").cast("bigint").alias("content_length"),
        F.col("rest"),
    )
    # the last record of a file still has the blank lines that end it
    block = F.when(F.octet_length("rest") == F.col("content_length") + 4, F.col("rest").substr(F.lit(1), F.length("rest") - 4)).otherwise(F.col("rest"))
    out = out.withColumn("block", block).drop("rest")
    whole = (F.octet_length("block") == F.col("content_length")) & ((F.col("record_type") != "response") | (base32_sha1(F.col("block")) == F.col("payload_digest")))
    return out.withColumn("whole", whole)


class LoserTree:
    """Tournament of k sorted cursors: each inner place keeps the loser, the winner is on top."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.keys: list[tuple | None] = [r[0] if r else None for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) of all entries in order."""
        while self.keys[w := self.losers[0]] is not None:
            yield w, self.at[w]
            self.at[w] += 1
            self.keys[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else None
            self._play(w)


def sorted_runs(records: DataFrame, path: str) -> int:
    """Write the index entries, each file a run sorted by URL key and time; returns how many entries."""
    order = ["url_key", "capture_ts", "page_id"]
    entries = records.withColumn("url_key", url_key(F.col("url"))).select([x.split()[0] for x in INDEX.split(", ")])
    entries.sortWithinPartitions(*order).write.parquet(path)
    return records.sparkSession.read.parquet(path).count()


_KEY = ("url_key", "capture_ts", "page_id")
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
#: Entries of the sample for each range, and entries of a block.
SAMPLED, BLOCK_ROWS = 20, 20_000


def _keys(batch: pa.RecordBatch | pa.Table) -> list[tuple]:
    """The order of the entries as tuples; a null id comes first, as in Spark."""
    low = -(1 << 63)
    url, ts, page = (batch.column(c) for c in _KEY)
    return list(zip([x.encode() for x in url.to_pylist()], ts.cast(pa.int64()).to_pylist(), [low if x is None else x for x in page.to_pylist()], strict=True))


def range_bounds(runs: DataFrame, rows: int, n: int) -> list[tuple]:
    """Up to ``n`` - 1 keys that cut the order into ranges, from about ``SAMPLED`` entries for each."""
    if n < 2:
        return []
    draw = F.pmod(F.xxhash64(*_KEY, F.lit(5)), F.lit(1 << 30)) < int(min(1.0, SAMPLED * n / max(1, rows)) * (1 << 30))
    sample = sorted(_keys(runs.filter(draw).select(*_KEY).toArrow()))
    return sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []


def merged_index(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The runs under ``path`` as one capture history: partitions are ranges in order, each in order."""
    runs = spark.read.schema(INDEX).parquet(path)
    n = max(1, math.ceil(rows / RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")) if rows > 10_000 else 1)
    bounds = spark.sparkContext.broadcast(range_bounds(runs, rows, n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, last, before, cuts = uuid.uuid4().hex, 0, 0, None, bounds.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                keys = _keys(part)
                files = part.column("file").to_pylist()
                segments = [0, *(i for i in range(1, len(keys)) if files[i] != files[i - 1]), len(keys)]
                ends = sorted({x for s, e in zip(segments, segments[1:], strict=False) for x in (s, e, *(bisect_left(keys, c, s, e) for c in cuts))})
                for a, b in zip(ends, ends[1:], strict=False):
                    if before is not None and (files[a] != before[0] or keys[a] < before[1]):
                        last += 1  # another run, or a run that was read in parts
                    before = (files[b - 1], keys[b - 1])
                    sink = pa.BufferOutputStream()
                    entries = part.slice(a, b - a).select(_NAMES)
                    with pa.ipc.new_stream(sink, entries.schema) as stream:
                        stream.write_batch(entries)
                    yield pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts, keys[a])], pa.int32()), pa.array([f"{task}-{last}"]), pa.array([place], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rng", "run", "place", "entries"])
                    place += 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tables = [], []
        for batch in batches:  # by run and place
            names += batch.column("run").to_pylist()
            tables += [pa.ipc.open_stream(x).read_all() for x in batch.column("entries").to_pylist()]
        if not tables:
            return
        sizes = [t.num_rows for t in tables]
        table = pa.concat_tables(tables).combine_chunks()
        keys = _keys(table)
        starts, at = [], 0
        for i, size in enumerate(sizes):
            if not i or names[i] != names[i - 1]:
                starts.append(at)
            at += size
        order = [starts[r] + i for r, i in LoserTree([keys[a:b] for a, b in zip(starts, [*starts[1:], at], strict=True)])]
        yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches()

    blocks = runs.withColumn("file", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))).mapInArrow(cut, "rng int, run string, place bigint, entries binary")
    return blocks.repartitionById(n, "rng").sortWithinPartitions("run", "place").mapInArrow(merge, INDEX)


def capture_history(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages to archives, read them back, and return the merged index, one row per page.

    A null payload is empty; equal empty payloads are revisits of the largest id too when
    ``least_bytes`` is 0. Rows without id are response records and last among equals. Rows with the
    same id and payload are both responses. An empty table gives no rows. Other columns are not read.
    Records that came back incomplete raise an error.
    """
    spark = pages.sparkSession
    archives, runs = scratch_path(spark, "archives"), scratch_path(spark, "index-runs")
    run = write_archives(pages, archives, least_bytes, id_col, url_col, payload_col)
    records = read_archives(spark, archives, run)
    checked = records.withColumn("page_id", F.when(F.col("whole"), F.col("page_id")).otherwise(F.raise_error(F.lit("a record is not whole")).cast("bigint")))
    rows = sorted_runs(checked, runs)
    return merged_index(spark, runs, rows)
