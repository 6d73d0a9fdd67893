"""Line dedup over sharded cuckoo filters backed by exact reference-count tables.

A store keeps, in a shared folder, the postings (document, line key), reference counts per key
and one cuckoo filter per shard of the key space. An insertion first adds the batch up by key (so a
line of a third of all documents is one row), then asks each shard's filter which of these keys may
be known. Keys that the filter rules out are new for certain; only the others meet the exact counts
in a join. A deletion writes negative counts, takes keys that nobody holds any longer out of the
filters, and so the next ``apply`` gives the lines back that were dropped on the deleted documents'
account. A manifest names the tables of each version, so a later session opens the store where this one left it, and
a retried insertion finds its postings there and changes nothing. Shards are dealt anew when keys outgrow them.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_rest, byte_texts, carried, id_and_text, mixed, rebatched, scratch_path, with_rest

_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
#: Keys for each shard, about; a filter entry takes two bytes at up to 85 % load.
KEYS_PER_SHARD = 500_000
#: Insertions of the query: all but the first ask filters that know something.
BATCHES = 3


def line_key(line: bytes, least: int) -> bytes | None:
    """MD5 of the stripped line with A-Z lower-cased; None under ``least`` code points."""
    key = line.strip(_SPACE).translate(_LOWER)
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return hashlib.md5(key).digest()


class CuckooFilter:
    """Cuckoo filter with 16-bit fingerprints, four to a bucket, filled in bulk.

    When a table overflows a new one of twice the size is added; a look-up asks all of them.
    """

    def __init__(self, tables: list[np.ndarray] | None = None, capacity: int = 1024) -> None:
        self.tables = tables or [self._empty(capacity)]

    @staticmethod
    def _empty(capacity: int) -> np.ndarray:
        return np.zeros((1 << max(4, math.ceil(math.log2(max(1, capacity) / 0.85 / 4))), 4), np.uint16)

    @staticmethod
    def _prints(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    @staticmethod
    def _other(bucket: np.ndarray, prints: np.ndarray, table: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(prints.astype(np.uint64)) & np.uint64(len(table) - 1)).astype(np.int64)

    def _homes(self, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = self._prints(keys)
        first = (keys & np.uint64(len(table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints, table)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for table in self.tables:
            prints, a, b = self._homes(keys, table)
            found |= (table[a] == prints[:, None]).any(1) | (table[b] == prints[:, None]).any(1)
        return found

    def insert(self, keys: np.ndarray) -> None:
        while len(keys):
            table = self.tables[-1]
            room = int(0.85 * table.size) - int(np.count_nonzero(table))
            now, keys = keys[: max(0, room)], keys[max(0, room) :]
            prints, bucket, _ = self._homes(now, table)
            self._place(table, prints, bucket)
            if len(keys):
                self.tables.append(self._empty(max(len(keys), 2 * table.size)))

    def _place(self, table: np.ndarray, prints: np.ndarray, bucket: np.ndarray) -> None:
        """Each round serves one entry of each bucket: a free slot, or it evicts another entry."""
        for turn in range(2000):
            if not len(prints):
                return
            at, first = np.unique(bucket, return_index=True)
            own = prints[first]
            free = table[at] == 0
            slot = np.where(free.any(1), free.argmax(1), turn % 4)
            evicted = table[at, slot]
            table[at, slot] = own
            rest = np.ones(len(prints), bool)
            rest[first] = False
            out = evicted != 0
            waiting, where = prints[rest], bucket[rest]
            prints = np.concatenate([waiting, evicted[out]])
            bucket = np.concatenate([self._other(where, waiting, table), self._other(at[out], evicted[out], table)])
        raise OverflowError(f"{len(prints)} entries found no place in {len(table)} buckets")

    def delete(self, keys: np.ndarray) -> None:
        """Take out one entry for each key; only keys that were inserted may be given."""
        for key in keys:
            one = np.array([key], np.uint64)
            for table in self.tables:
                prints, a, b = self._homes(one, table)
                spots = [(h, s) for h in (int(a[0]), int(b[0])) for s in range(4) if table[h, s] == prints[0]]
                if spots:
                    table[spots[0]] = 0
                    break

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        tables, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            tables.append(np.frombuffer(data, np.uint16, n * 4, at + 8).reshape(n, 4).copy())
            at += 8 + n * 8
        return cls(tables)


def _numbers(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2].copy() if keys else np.empty(0, np.uint64)


def line_postings(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, key) of the long enough lines of each row, each key once a row; null ids have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text"):
            ids, keys = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch, "text"), strict=True):
                own = {line_key(x, least) for x in set(text.split(b"\n"))} - {None}
                ids += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return docs.filter("doc_id is not null").mapInArrow(run, "doc_id bigint, key binary")


#: own: the key has an entry of its own in its filter; else it was taken for one that has (rare).
_POSTINGS = "doc_id bigint, key binary"
_MANIFEST = "version int, least int, shards int, keys bigint, postings array<string>, counts string, filters string"
_COUNTS = "shard int, key binary, refs bigint, first_doc bigint, own boolean"


class LineStore:
    """Reversible line dedup state; all tables are in the shared folder.

    ``LineStore(spark)`` is a new store, ``LineStore.open(spark, store.path)`` one that was left there. Tables that a
    newer version no longer names stay until the folder is deleted.
    """

    def __init__(self, spark: SparkSession, least: int = 10, path: str | None = None) -> None:
        self.spark, self.least, self.path = spark, least, path or scratch_path(spark, "line-store")
        self.version, self.shards, self.keys = 0, 0, 0
        self.postings: list[str] = []
        self.counts: str | None = None
        self.filters: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineStore:
        """The store's last version; a folder without one is a new store."""
        out = cls(spark, path=path)
        try:
            row = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:
            row = None
        if row:
            out.version, out.least, out.shards, out.keys, out.postings, out.counts, out.filters = row.version, row.least, row.shards, row.keys, list(row.postings), row.counts, row.filters
        return out

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known_new: bool = False) -> None:
        """Add documents. Lines that the store has of the same id count once, so a retried batch does no harm.

        ``known_new`` says that no id is in the store, and saves the look-up.
        """
        postings = line_postings(id_and_text(docs, id_col, text_col), self.least).distinct()
        if self.postings and not known_new:
            postings = postings.join(self._postings(), ["doc_id", "key"], "left_anti")
        mine = self._write(postings, "postings")
        postings = self._read(mine, _POSTINGS)
        if not self.shards:
            self.shards = max(8, math.ceil(postings.count() / KEYS_PER_SHARD))
        added = self._read(self._write(self._probe(self._by_key(postings), self._filters()), "probed"), f"{_COUNTS}, filter binary")
        new = added.filter("filter is null").drop("filter")
        # only keys that the filters know of meet the exact counts
        known = new.filter("not own")
        old = self._counts().join(known.select("key"), "key", "left_semi").select(known.columns)
        merged = known.unionByName(old).groupBy("shard", "key").agg(F.sum("refs").alias("refs"), F.min("first_doc").alias("first_doc"), F.max("own").alias("own"))
        rest = self._counts().join(known.select("key"), "key", "left_anti").select(known.columns)
        counts = rest.unionByName(merged.select(known.columns)).unionByName(new.filter("own")) if self.counts else new
        self._commit([*self.postings, mine], self._write(counts, "counts"), self._write(added.filter("filter is not null").select("shard", "filter"), "filters"))
        if self.keys > 2 * self.shards * KEYS_PER_SHARD:
            self._deal_anew()

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out; lines that only they shared with another document are whole again. Unknown ids do nothing."""
        if not self.counts:
            return
        gone = doc_ids.select(F.col(f"`{id_col}`").alias("doc_id")).distinct()
        every = self._postings()
        lost = self._by_key(every.join(gone, "doc_id", "left_semi")).select("key")
        mine = self._write(every.join(gone, "doc_id", "left_anti"), "postings")
        touched = self._by_key(self._read(mine, _POSTINGS).join(lost, "key", "left_semi"))
        counts = self._counts()
        touched = touched.join(counts.select("key", "own"), "key").select(counts.columns)
        live = self._read(self._write(counts.join(lost, "key", "left_anti").select(counts.columns).unionByName(touched), "counts"), _COUNTS)
        dead = counts.filter("own").join(lost, "key", "left_semi").join(touched.select("key"), "key", "left_anti")
        changes = dead.select("shard", "key", F.lit(True).alias("out")).unionByName(live.filter("not own").select("shard", "key", F.lit(False).alias("out")))
        changed = self._read(self._write(self._changed(changes), "changed"), "shard int, filter binary, key binary")
        same = self._filters().join(changed.select("shard").distinct(), "shard", "left_anti")
        filters = self._write(changed.filter("filter is not null").select("shard", "filter").unionByName(same.select("shard", "filter")), "filters")
        owned = changed.filter("key is not null").select("key", F.lit(True).alias("now"))
        live = live.join(owned, "key", "left").withColumn("own", F.col("own") | F.coalesce("now", F.lit(False))).select(counts.columns)
        self._commit([mine], self._write(live, "counts"), filters)

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
        """doc_id, n_lines, n_dropped and the kept text of each row, under the present state; an empty store drops nothing."""
        shared = self._counts().filter("refs >= 2").select("key", "first_doc")
        drops = self._postings().join(shared, "key").filter("doc_id > first_doc").groupBy("doc_id").agg(F.collect_list("key").alias("drops"))
        own = id_and_text(docs, id_col, text_col, *(carried(docs, text_col) if carry else ())).join(drops, "doc_id", "left")
        return own.mapInArrow(_without_lines(self.least), with_rest("doc_id bigint, n_lines bigint, n_dropped bigint, text string", own, ("rest",)))

    def _deal_anew(self) -> None:
        """More shards, and filters that are built again from the exact counts."""
        self.shards = math.ceil(self.keys / KEYS_PER_SHARD)
        every = self._counts().select(self._shard().alias("shard"), "key", "refs", "first_doc")
        added = self._read(self._write(self._probe(every, self.spark.createDataFrame([], "shard int, filter binary")), "probed"), f"{_COUNTS}, filter binary")
        self._commit(self.postings, self._write(added.filter("filter is null").drop("filter"), "counts"), self._write(added.filter("filter is not null").select("shard", "filter"), "filters"))

    def _write(self, df: DataFrame, name: str) -> str:
        at = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return at

    def _read(self, path: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def _commit(self, postings: list[str], counts: str, filters: str) -> None:
        self.version, self.postings, self.counts, self.filters = self.version + 1, postings, counts, filters
        self.keys = self._counts().count()
        row = (self.version, self.least, self.shards, self.keys, postings, counts, filters)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _counts(self) -> DataFrame:
        return self._read(self.counts, _COUNTS)

    def _filters(self) -> DataFrame:
        return self._read(self.filters, "shard int, filter binary")

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(*self.postings) if self.postings else self._read(None, _POSTINGS)

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _by_key(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc")).select(self._shard().alias("shard"), "key", "refs", "first_doc")

    def _probe(self, counts: DataFrame, filters: DataFrame) -> DataFrame:
        """The counts with ``own`` (the filter did not know the key), then each shard's filter with them in it."""

        def run(new: pa.Table, old: pa.Table) -> pa.Table:
            keys = _numbers(new.column("key").to_pylist())
            states = old.column("filter").to_pylist()
            own = CuckooFilter.load(states[0]) if states else CuckooFilter(capacity=len(keys))
            maybe = own.contains(keys)
            own.insert(keys[~maybe])
            shard = (new if new.num_rows else old).column("shard")[0].as_py()
            rows = new.select(["shard", "key", "refs", "first_doc"]).append_column("own", pa.array(~maybe)).append_column("filter", pa.nulls(len(keys), pa.binary()))
            state = pa.table({"shard": pa.array([shard], pa.int32()), "key": pa.nulls(1, pa.binary()), "refs": pa.nulls(1, pa.int64()), "first_doc": pa.nulls(1, pa.int64()), "own": pa.nulls(1, pa.bool_()), "filter": pa.array([own.dump()], pa.binary())})
            return pa.concat_tables([rows.cast(state.schema), state])

        return counts.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, f"{_COUNTS}, filter binary")

    def _changed(self, changes: DataFrame) -> DataFrame:
        """Filters of the shards that change, and keys that got an entry: dead keys leave; keys that leaned on their entries come in."""

        def run(keys: pa.Table, old: pa.Table) -> pa.Table:
            own = CuckooFilter.load(old.column("filter")[0].as_py())
            names, out = keys.column("key").to_pylist(), keys.column("out").to_numpy()
            numbers = _numbers(names)
            own.delete(numbers[out])
            new = np.flatnonzero(~out)
            new = new[~own.contains(numbers[new])]
            own.insert(numbers[new])
            shard = old.column("shard")[0].as_py()
            return pa.table({"shard": pa.array([shard] * (len(new) + 1), pa.int32()), "filter": pa.array([own.dump()] + [None] * len(new), pa.binary()), "key": pa.array([None] + [names[i] for i in new.tolist()], pa.binary())})

        return changes.groupBy("shard").cogroup(self._filters().join(changes.select("shard").distinct(), "shard", "left_semi").groupBy("shard")).applyInArrow(run, "shard int, filter binary, key binary")


def _without_lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text"):
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(byte_texts(batch, "text"), batch.column("drops").to_pylist(), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if drops:
                    gone = set(drops)
                    lines = [x for x in lines if line_key(x, least) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield add_rest(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"]), batch, ("rest",))

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, carry: bool = False, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept text of each row, after inserting all rows into a new store.

    The rows come in ``batches`` insertions by a hash of the id: of the later ones only keys that the filters may know
    meet the exact counts. Lines whose key has ``least`` code points or more and is in two documents or more stay only in
    the document with the smallest id. A null text is one empty line. Rows with the same id are one
    document, and each row is rewritten; rows without id hold no keys and keep all lines. An empty
    table gives no rows. Other columns are not read; with ``carry`` a struct ``rest`` of them follows.
    """
    store = LineStore(docs.sparkSession, least)
    batch = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("bigint")), F.lit(batches))
    for k in range(batches):
        store.insert(docs.filter(batch == k), id_col, text_col, known_new=True)
    return store.apply(docs, id_col, text_col, carry)
