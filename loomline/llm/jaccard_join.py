"""N-gram Jaccard join: size-aware heavy-light join over word shingles, and its link components.

1. Shingle hashes go to groups of the hash space; what no second row holds is never answered. A row
   whose answered shingles are under the needed share of its set can have no link and is done: of
   ordinary text only near-copies and passages remain, with their sets.
2. Equal sets are one: the smallest row stands for them.
3. Light sets (size up to a boundary chosen by cost over all sizes): all subsets of the overlap that a
   pair of sizes needs are enumerated; sets with such a subset in common are linked to the smallest
   of them, which keeps all of them connected.
4. Heavy sets: inverted lists of the rarest shingles. A pair that links has one of them in common, so
   the connected lists are blocks that no link leaves. In a block all sets meet its hub (the set of
   the commonest shingles); only sets that the hub does not link are then compared with the whole
   block, in tiles of bounded size. So thousands of copies of one text need one comparison each, and
   no link between different texts is lost.
5. Shingles are told apart by 64-bit hashes on the way, so links are confirmed at the end by the words of both
   texts (texts that are equal byte for byte need none); should one be refuted, all is done again under another seed.
6. Components of the links; copies follow their representative.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import WordHasher, byte_texts, id_and_text, mixed, rebatched, window_hashes, written
from .components import components

CHUNK_BYTES = 3 << 20
GROUP_SHINGLES = 500_000
BUCKET_ROWS = 4000
#: Sets on a side of a tile.
TILE = 2048
#: Largest boundary between light and heavy that is considered.
MOST_LIGHT = 14
#: Rows next to each other that go to the same bucket, and dealt sets that one comparing task takes, about.
LOT_ROWS = 512
UNIT_ROWS = 8192
#: Bits of the filter for asked texts: for each of them, and at most (8 MB).
BITS_EACH = 16
MOST_BITS = 1 << 26
_BITMAP = 1 << 15
_ONE, _MANY, _SHARED, _SIZE, _ID, _FIRST_HALF, _SECOND_HALF = range(7)
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def needed(s: int, t: int, percent: int = 80) -> int:
    """Least intersection of sets of sizes s and t that link: 100*i >= percent*(s+t-i)."""
    return -(-percent * (s + t) // (100 + percent))


def shingle_set(text: bytes, width: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than ``width`` are one shingle."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hasher(words), min(width, len(words))) + np.uint64(min(width, len(words))))


def _shingles(texts: DataFrame, width: int, groups: int, buckets: int, seed: int) -> DataFrame:
    """Packed shingles by group of the hash space; what needs no answer goes by bucket of the row, numbered from ``groups`` on.

    A shingle that two rows of a chunk hold is answered there; its group gets it once for the chunk.
    """
    low = np.uint64(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(seed)
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            rows = np.array(batch.column("row").to_pylist(), np.int64)
            texts = byte_texts(batch, "text")
            sets = [shingle_set(t, width, hasher) for t in texts]
            sizes = np.array(list(map(len, sets)), np.int64)
            ids = batch.column("doc_id").to_pylist()
            bucket = groups + _bucket(rows, buckets)
            yield packed.pack(bucket, rows, sizes.astype(np.uint64), _SIZE)
            digests = np.frombuffer(b"".join(hashlib.md5(t).digest() for t in texts), np.uint64).reshape(-1, 2)
            yield packed.pack(bucket, rows, digests[:, 0], _FIRST_HALF)
            yield packed.pack(bucket, rows, digests[:, 1], _SECOND_HALF)
            has = np.array([x is not None for x in ids], bool)
            yield packed.pack(bucket[has], rows[has], np.array([x for x in ids if x is not None], np.int64).view(np.uint64), _ID)
            values, owners = np.concatenate(sets), np.repeat(rows, sizes)
            if not len(values):
                continue
            order, number = packed.classes(values)
            count = np.bincount(number)
            lead = order[np.flatnonzero(np.diff(number, prepend=-1))]
            many = count > 1
            shared = order[many[number]]
            shared.sort()
            yield packed.pack(groups + _bucket(owners[shared], buckets), owners[shared], values[shared], _SHARED)
            for kind, pick in ((_ONE, lead[~many]), (_MANY, lead[many])):
                pick.sort()
                yield packed.pack((values[pick] % low).astype(np.int64), owners[pick], values[pick], kind)

    return texts.mapInArrow(run, packed.SCHEMA)


def _bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    """Rows near each other share a bucket, so a chunk meets few of them."""
    return (mixed((rows // LOT_ROWS).astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _answers(pairs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """By bucket of rows: the shingles that a second row holds, sizes, digests and ids."""

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return packed.empty()
        group = table.column("grp")[0].as_py()
        if group >= groups:  # by bucket already
            return table.set_column(0, "grp", pa.array(np.full(table.num_rows, group - groups, np.int32)))
        one, many = packed.unpack(table, _ONE), packed.unpack(table, _MANY)
        values = np.concatenate([one[1], many[1]])
        order, number = packed.classes(values)
        held = np.bincount(number) if len(number) else np.empty(0, np.int64)
        held[number[order >= len(one[1])]] += 1
        answered = order[held[number] > 1]
        answered = answered[answered < len(one[1])]
        rows, values = one[0][answered], one[1][answered]
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
        out = packed.pack(_bucket(rows, buckets), rows, values, _SHARED)
        return pa.Table.from_batches([out])

    return pairs.groupBy("grp").applyInArrow(run, packed.SCHEMA)


def _sets(answers: DataFrame, percent: int) -> DataFrame:
    """One row for each input row; ``tokens`` only where enough of the set is held elsewhere too."""

    def run(table: pa.Table) -> pa.Table:
        rows, sizes = packed.unpack(table, _SIZE)
        order = np.argsort(rows, kind="stable")
        rows, sizes = rows[order], sizes[order].astype(np.int64)
        with_id = dict(zip(*(x.tolist() for x in packed.unpack(table, _ID)), strict=True))
        owners, values = packed.unpack(table, _SHARED)
        order = np.lexsort((values, owners))
        owners, values = owners[order], values[order]
        starts, ends = np.searchsorted(owners, rows), np.searchsorted(owners, rows, side="right")
        halves = [packed.unpack(table, kind) for kind in (_FIRST_HALF, _SECOND_HALF)]
        halves = np.stack([half[1][np.argsort(half[0], kind="stable")] for half in halves], 1)
        digests = [x.tobytes() for x in halves]
        tokens, signs = [], []
        for row, size, a, b in zip(rows.tolist(), sizes.tolist(), starts.tolist(), ends.tolist(), strict=True):
            own = values[a:b] if b > a and 100 * (b - a) >= percent * size else None
            tokens.append(None if own is None else own.view(np.int64))
            alone = b"" if b - a == size else row.to_bytes(8, "little")  # a shingle of its own: equal to no other set
            signs.append(None if own is None else hashlib.md5(own.tobytes() + alone).digest())
        ids = [with_id.get(r) for r in rows.tolist()]
        ids = [None if x is None else x - (1 << 64) if x >= 1 << 63 else x for x in ids]
        return pa.table({"row": pa.array(rows), "doc_id": pa.array(ids, pa.int64()), "size": pa.array(sizes), "tokens": pa.array(tokens, pa.list_(pa.int64())), "sign": pa.array(signs, pa.binary()), "digest": pa.array(digests, pa.binary())})

    return answers.groupBy("grp").applyInArrow(run, "row bigint, doc_id bigint, size bigint, tokens array<bigint>, sign binary, digest binary")


def overlaps(s: int, most: int, percent: int) -> set[int]:
    """The overlaps that a set of size s needs with sets of up to ``most`` that it can link to."""
    return {k for t in range(1, most + 1) if (k := needed(s, t, percent)) <= min(s, t)}


def light_boundary(sizes: dict[int, int], percent: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, over all sets."""

    def subsets(s: int, most: int) -> int:
        return sum(math.comb(s, k) for k in overlaps(s, most, percent))

    def prefix(s: int) -> int:
        return s - -(-percent * s // 100) + 1

    def cost(x: int) -> int:  # a scanned entry meets its list, the hub and the component rounds
        return sum(n * subsets(s, x) for s, n in sizes.items() if s <= x) + 8 * sum(n * prefix(s) for s, n in sizes.items() if 100 * s >= percent * (x + 1))

    return min(range(MOST_LIGHT + 1), key=cost)


def _light_links(sets: DataFrame, most: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, size, tokens in zip(*(batch.column(c).to_pylist() for c in ("row", "size", "tokens")), strict=True):
                for k in overlaps(size, most, percent):
                    rows += [(row, size, k, hashlib.md5(np.array(x, np.int64).tobytes()).digest()) for x in combinations(tokens, k)] if k <= len(tokens) else []
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["row", "size", "k", "subset"])

    subsets = sets.filter(F.col("size") <= most).select("row", "size", "tokens").mapInArrow(run, "row bigint, size bigint, k bigint, subset binary")
    hubs = subsets.groupBy("k", "subset").agg(F.min(F.struct("size", "row")).alias("hub"))
    need = F.ceil(F.lit(percent) * (F.col("size") + F.col("hub.size")) / (100 + percent))
    return subsets.join(hubs, ["k", "subset"]).filter((F.col("row") != F.col("hub.row")) & (need <= F.col("k"))).select(F.col("row").alias("a"), F.col("hub.row").alias("b"))


def _heavy_links(sets: DataFrame, light: int, percent: int) -> DataFrame:
    spark = sets.sparkSession
    heavy = sets.filter(100 * F.col("size") >= percent * (light + 1))
    entries = heavy.select("row", "size", F.explode("tokens").alias("token"))
    held = entries.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    lists = entries.join(held, "token").groupBy("row", "size").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("t"), F.sum("held").alias("weight"))
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("t"))
    lists = written(lists.filter(prefix > 0).select("row", "size", "weight", F.transform("t", lambda x: x["token"]).alias("tokens"), prefix.cast("int").alias("n")), "lists")
    first = lists.select("row", F.explode(F.slice("tokens", F.lit(1), F.col("n"))).alias("token"))
    firsts = first.groupBy("token").agg(F.min("row").alias("b"), F.count("*").alias("k")).filter("k > 1").drop("k")
    near = first.join(firsts, "token").filter("row <> b").select(F.col("row").alias("a"), "b").distinct()
    blocks = components(near)
    members = written(lists.join(blocks, F.col("row") == F.col("node")).select("row", "size", "weight", F.sort_array("tokens").alias("tokens"), F.col("component").alias("block")), "members")
    hubs = members.groupBy("block").agg(F.max(F.struct("weight", "row", "size", "tokens")).alias("hub"), F.count("*").alias("n"))
    met = members.join(hubs, "block").filter(F.col("row") != F.col("hub.row"))
    both = F.size(F.array_intersect("tokens", "hub.tokens"))
    met = written(met.select("row", "block", "n", F.col("hub.row").alias("hub"), (100 * both >= percent * (F.col("size") + F.col("hub.size") - both)).alias("linked")), "met")
    by_hub = met.filter("linked").select(F.col("row").alias("a"), F.col("hub").alias("b"))
    open_rows = met.filter("not linked and n > 2").select("row", "block")
    n_open = open_rows.groupBy("block").agg(F.count("*").alias("open"))
    sizes = members.groupBy("block").agg(F.count("*").alias("all")).join(n_open, "block")
    tiles = sizes.withColumn("qs", F.ceil(F.col("open") / TILE).cast("int")).withColumn("ms", F.ceil(F.col("all") / TILE).cast("int"))
    slot = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    marked = members.join(open_rows.withColumn("is_open", F.lit(True)), ["row", "block"], "left").join(tiles, "block").select("row", "size", "tokens", "block", "qs", "ms", F.coalesce("is_open", F.lit(False)).alias("is_open"))
    whole = lambda q, m, query: F.struct(q.alias("q"), m.alias("m"), F.lit(query).alias("query"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: whole(q, slot("ms"), False))
    as_query = F.when(F.col("is_open"), F.transform(F.sequence(F.lit(0), F.col("ms") - 1), lambda m: whole(slot("qs"), m, True))).otherwise(F.array().cast("array<struct<q:int,m:int,query:boolean>>"))
    dealt = marked.select("row", "size", "tokens", "block", F.explode(F.concat(as_member, as_query)).alias("tile")).select("row", "size", "tokens", "block", "tile.q", "tile.m", "tile.query")
    n_dealt = tiles.agg(F.sum(F.col("all") * F.col("qs") + F.col("open") * F.col("ms"))).first()[0] or 1
    units = max(1, math.ceil(n_dealt / UNIT_ROWS))
    dealt = dealt.withColumn("unit", F.pmod(F.xxhash64("block", "q", "m"), F.lit(max(units, int(spark.conf.get("spark.sql.shuffle.partitions"))))).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        a, b = [], []
        data = table.sort_by([("block", "ascending"), ("q", "ascending"), ("m", "ascending")]).combine_chunks()
        keys = np.stack([data.column(c).to_numpy() for c in ("block", "q", "m")]) if data.num_rows else np.empty((3, 0))
        starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0)))) if data.num_rows else []
        for at, to in zip(starts, [*starts[1:], data.num_rows], strict=True):
            for x, y in tile_links(data.slice(at, to - at), percent):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return by_hub.union(dealt.groupBy("unit").applyInArrow(compare, "a bigint, b bigint"))


def tile_links(tile: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    """Links between the queries and the members of a tile; of several members linked to a query, all."""
    query = tile.column("query").to_numpy()
    members = tile.filter(pa.array(~query)).combine_chunks()
    rows, sizes = members.column("row").to_numpy(), members.column("size").to_numpy()
    if not len(rows) or not query.any():
        return
    lists = members.column("tokens").chunk(0)
    offsets = lists.offsets.to_numpy()
    names, flat = np.unique(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], return_inverse=True)
    starts = offsets[:-1] - offsets[0]
    mark = np.zeros(len(names) + 1, np.int32)
    queries = tile.filter(pa.array(query))
    for row, size, tokens in zip(queries.column("row").to_pylist(), queries.column("size").to_pylist(), queries.column("tokens").to_pylist(), strict=True):
        own = np.array(tokens, np.int64)
        at = np.searchsorted(names, own)
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == own)]
        mark[at] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[at] = 0
        linked = (100 * both >= percent * (size + sizes - both)) & (rows != row)
        yield from ((row, int(r)) for r in rows[linked])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row.

    A-Z are lower-cased; words are split at white space. Two rows link when 100 * intersection >=
    ``percent`` * union of their sets of ``width``-word shingles; a component is named by its smallest
    doc_id. Fewer words than ``width`` are one shingle; texts without words have none and no links.
    Each row is a document of its own, also if ids repeat (the rows of one id then have the ids of
    their own components). A row without id takes part; its component is null if no member has an id.
    An empty table gives no rows. Other columns are not read.
    """
    known = _row_components(id_and_text(docs, id_col, text_col, F.monotonically_increasing_id().alias("row")), width, percent)
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return known.join(least, "component").select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def first_of_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One whole row of ``docs`` for each component: the one with the smallest id, a row without id only if none has one.

    Of several such rows one stays. Rows are numbered and written first, so ids may be null or repeat.
    """
    number = "row"
    while number in map(str.lower, docs.columns):
        number += "_"
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    known = _row_components(id_and_text(numbered, id_col, text_col, F.col(number).alias("row")), width, percent)
    first = known.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias(number))
    return numbered.join(first, number, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


def _row_components(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """row, doc_id, size and component (a row) of each row of (doc_id, text, row)."""
    n_rows, size = texts.select(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(128, math.ceil((size or 0) / 6 / GROUP_SHINGLES))
    buckets = max(1, math.ceil(n_rows / BUCKET_ROWS))
    for seed in itertools.count():
        sets, links = _row_links(texts, width, percent, groups, buckets, seed)
        if _refuted(links, texts, width, percent).isEmpty():
            break
    of = components(links)
    return sets.select("row", "doc_id", "size").join(of, F.col("row") == F.col("node"), "left").withColumn("component", F.coalesce("component", "row"))


def _row_links(texts: DataFrame, width: int, percent: int, groups: int, buckets: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their set sizes, and links (a, b) between rows with the digests of both texts."""
    sets = written(_sets(_answers(_shingles(texts, width, groups, buckets, seed), groups, buckets), percent), "sets")
    kept = sets.filter("tokens is not null")
    first = kept.groupBy("sign").agg(F.min(F.struct("row", "digest")).alias("first"))
    copies = kept.join(first, "sign").filter("row <> first.row").select(F.col("row").alias("a"), F.col("first.row").alias("b"), F.col("digest").alias("da"), F.col("first.digest").alias("db"))
    single = written(kept.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select("row", "size", "tokens"), "single")
    light = light_boundary({r["size"]: r["n"] for r in single.filter(F.col("size") <= 2 * MOST_LIGHT).groupBy("size").agg(F.count("*").alias("n")).collect()}, percent)
    near = _light_links(single, light, percent).union(_heavy_links(single, light, percent))
    digests = kept.select("row", "digest")
    named = near.join(digests.select(F.col("row").alias("a"), F.col("digest").alias("da")), "a").join(digests.select(F.col("row").alias("b"), F.col("digest").alias("db")), "b")
    return sets, written(copies.unionByName(named), "found")


def _refuted(links: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links whose texts, shingle by shingle in words, do not reach ``percent``; equal texts are not looked at."""
    pairs = links.filter("da <> db").select(F.least("da", "db").alias("da"), F.greatest("da", "db").alias("db")).distinct()
    asked = pairs.select(F.col("da").alias("d")).union(pairs.select("db")).distinct()
    asked = written(asked, "asked")  # distinct: an inner join will do, and unlike a semi join it is not pushed below the filter
    digested = texts.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("d"), "text")
    held = maybe_asked(digested, asked).join(asked, "d").groupBy("d").agg(F.any_value("text").alias("text"))
    both = pairs.join(held.select(F.col("d").alias("da"), F.col("text").alias("ta")), "da").join(held.select(F.col("d").alias("db"), F.col("text").alias("text")), "db")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text"):
            wrong = []
            for one, two in zip(byte_texts(batch, "ta"), byte_texts(batch, "text"), strict=True):
                a, b = exact_shingles(one, width), exact_shingles(two, width)
                wrong.append(100 * len(a & b) < percent * len(a | b))
            yield batch.filter(pa.array(wrong, pa.bool_())).select(["da", "db"])

    return both.select("da", "db", "ta", "text").mapInArrow(run, "da binary, db binary")


def maybe_asked(rows: DataFrame, asked: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """All ``rows`` whose digest ``d`` is asked and few others: a bitmap of hashed digests keeps the rest out of the shuffle behind it.

    The bitmap stops growing at ``most_bits``; beyond that more of the others pass, and never is an asked row lost.
    """
    bits = max(_BITMAP, min(most_bits, BITS_EACH * asked.count()))
    place = F.pmod(F.xxhash64("d"), F.lit(bits))
    part, at = F.floor(place / _BITMAP).alias("part"), F.pmod(place, F.lit(_BITMAP)).cast("int").alias("at")
    maps = asked.select(part, at).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(F.col("at"), F.lit(8)))), F.lit(2)) == 1
    return rows.select("*", part, at).join(F.broadcast(maps), "part").filter(is_set).select(*rows.columns)


def exact_shingles(text: bytes, width: int) -> set[bytes]:
    """The text's distinct shingles as words joined by spaces."""
    words = text.translate(_LOWER).split()
    size = min(width, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
