"""Language-model scores by online logistic context mixing.

A text is its UTF-8 bytes and an end mark. Each symbol is a path of bits in a Huffman tree of the
training bytes, so a frequent byte takes few bits. Several predictors give each bit a probability,
each from a table of counts hashed by its context (the last one to five bytes) and the tree node.
Their logits are mixed with weights that a gate (depth in the tree, letter before) selects.

Training takes two parts of the training texts, told apart by a hash of the text: most fill the count tables,
one in ``TUNING`` moves the weights. The latter are dealt to shards by that hash and sorted in each, and a
shard goes through its texts stretch by stretch: it predicts the bits, then moves the weights of each gate against
the error. The weights of all shards are averaged by bits. Neither counts nor weights depend on how the
input is split into tasks. A text is then scored under a flatter and a sharper gain of the
weights, whose shares are refined along the text by how well they have coded it so far.

A symbol and its five bytes of context fix all its bits' slots, so the work on bits is done once for
each different six-gram of a chunk. The tables grow with the training bytes up to ``MOST_BITS``, which bounds what is
broadcast; word counts for the base score are unbounded and stay distributed, as packed pairs by
hash group of the word. A word that many texts of a chunk hold goes to its group once for the chunk.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import WordHasher, byte_texts, id_and_text, mixed, rebatched, written

#: Bytes of context of each predictor, and by how many bits its table is smaller than the largest; that has about one slot
#: for each 128 bytes of training text (by then most contexts of five bytes are known), from ``LEAST_BITS`` to ``MOST_BITS``.
ORDERS, LESS = (1, 2, 3, 5), (0, 2, 1, 0)
LEAST_BITS, MOST_BITS = 20, 24
#: One training text in how many moves the weights, bytes of them that a shard takes, about, and bytes between two moves.
TUNING, SHARD_BYTES, MOVE_BYTES = 32, 4 << 20, 1 << 16
#: Weights before training, step of an online refinement, gains mixed for a text, symbols between refinements.
START = np.array([0.10, 0.20, 0.35, 0.45], np.float32)
STEP = np.float32(0.25)
GAINS = (0.8, 1.2)
STRETCH = 128
GATES = 8
END, NOTHING = 256, 257
CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 16
_PRIOR = 0.4
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_WORD, _SIGN, _SUMS, _TOTALS, _COMMON, _HELD, _TIMES = range(7)
#: A word that this many texts of a chunk hold is common in it.
COMMON = 8
#: Rows next to each other that go to the same bucket.
LOT_ROWS = 512


def table_bits(train_bytes: int) -> tuple[int, ...]:
    """log2 of the size of each predictor's table."""
    most = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, train_bytes) / 128))))
    return tuple(17 if order == 1 else most - less for order, less in zip(ORDERS, LESS, strict=True))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


class Code:
    """Huffman paths of the 257 symbols: tree nodes passed and bits taken, end to end."""

    def __init__(self, counts: np.ndarray) -> None:
        heap = [(int(c), i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        node = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[2]], parent[b[2]] = (node, 0), (node, 1)
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        paths = []
        for symbol in range(len(counts)):
            path, at = [], symbol
            while at in parent:
                at, bit = parent[at]
                path.append((at - len(counts), bit))
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.int32)
        self.start = np.cumsum(self.length) - self.length
        self.nodes = np.array([n for p in paths for n, _ in p], np.int32)
        self.bits = np.array([b for p in paths for _, b in p], np.uint8)
        self.depth = np.concatenate([np.arange(len(p)) for p in paths]).astype(np.int32)


def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, each text ended, and the length of each with its end."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    out = np.full(int(lengths.sum()), END, np.uint16)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(lengths) - 1] = False
    out[inner] = np.frombuffer(b"".join(texts), np.uint8)
    return out, lengths


def grams(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each symbol with the five before it in its text, nine bits each, the symbol lowest."""
    shift = 5 * np.arange(1, len(lengths) + 1)  # five places of nothing stand before each text
    at = np.arange(len(symbols)) + np.repeat(shift, lengths)
    wide = np.full(len(symbols) + 5 * len(lengths), NOTHING, np.uint64)
    wide[at] = symbols
    two = wide.copy()
    two[1:] |= wide[:-1] << np.uint64(9)
    four = two.copy()
    four[2:] |= two[:-2] << np.uint64(18)
    four[4:] |= two[:-4] << np.uint64(36)
    return four[at]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the place of each key among them.

    Hash and position are sorted as one number; should two keys share a hash, it is done the long way.
    """
    low = np.uint64(max(1, int(len(keys) - 1).bit_length()))
    mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ (keys >> np.uint64(29))
    mixed = ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> low << low) | np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    at = (mixed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    mixed >>= low
    lead = np.concatenate(([True], mixed[1:] != mixed[:-1]))
    ordered = keys[at]
    number = np.cumsum(lead, dtype=np.int32) - 1
    names = ordered[lead]
    if (names[number] != ordered).any():
        return np.unique(keys, return_inverse=True)
    place = np.empty(len(keys), np.int32)
    place[at] = number
    return names, place


class Bits:
    """The bits of six-grams: ``of`` which one, bit, gate, and each predictor's slot."""

    def __init__(self, code: Code, sizes: tuple[int, ...], keys: np.ndarray) -> None:
        symbols = (keys & np.uint64(511)).astype(np.int64)
        n = code.length[symbols]
        self.first = np.cumsum(n) - n
        self.of = np.repeat(np.arange(len(keys), dtype=np.int32), n)
        place = np.arange(len(self.of), dtype=np.int32) - np.repeat(self.first - code.start[symbols], n).astype(np.int32)
        self.bit = code.bits[place]
        node = code.nodes[place].astype(np.uint32)
        before = ((keys >> np.uint64(9)) & np.uint64(511)).astype(np.uint32)
        letter = (((before | 32) >= 97) & ((before | 32) < 123) | (before >= 128) & (before < 256)).astype(np.int32)
        self.gate = np.minimum(code.depth[place], 3) + 4 * letter[self.of]
        self.slots, spread = [], node * np.uint32(0x85EBCA6B)
        for order, size in zip(ORDERS, sizes, strict=True):
            if order == 1:
                self.slots.append((before << np.uint32(8))[self.of] + node)
                continue
            state = (keys >> np.uint64(9)) & np.uint64((1 << 9 * order) - 1)
            state = ((state * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
            self.slots.append((state[self.of] ^ spread) * np.uint32(0xC2B2AE35) >> np.uint32(32 - size))


def byte_counts(texts: DataFrame) -> np.ndarray:
    """How often each byte and the end are in the training texts, and once more so that none is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(257, np.int64)
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            symbols, _ = symbols_of(byte_texts(batch, "text"))
            counts += np.bincount(symbols, minlength=257)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257)), pa.array(counts)], names=["symbol", "n"])

    rows = texts.filter("not held_out").select("text").mapInArrow(run, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    out = np.ones(257, np.int64)
    for r in rows:
        out[r["symbol"]] += r["n"]
    return out


def logit(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + np.float32(_PRIOR)) / (zeros + np.float32(_PRIOR))), -9, 9).astype(np.float32)


_BLOCKS = "k int, block int, data binary"


def count_tables(texts: DataFrame, code: Code, sizes: tuple[int, ...], salts: int) -> list[np.ndarray]:
    """The logits of all slots of each predictor, from all ``texts``.

    Each task sends its counts by block of a table; blocks are added up in two steps, so no group holds a row of every task.
    """
    shared = texts.sparkSession.sparkContext.broadcast((code, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, sizes = shared.value
        counts = [np.zeros((2, 1 << b), np.int32) for b in sizes]
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            keys, at = distinct(grams(*symbols_of(byte_texts(batch, "text"))))
            n = np.bincount(at, minlength=len(keys)).astype(np.int32)
            bits = Bits(code, sizes, keys)
            times = n[bits.of]
            for count, slot in zip(counts, bits.slots, strict=True):
                np.add.at(count.reshape(-1), slot + bits.bit * np.int64(count.shape[1]), times)
        small = zstandard.ZstdCompressor(level=1)
        for k, count in enumerate(counts):
            for i in range(0, count.shape[1], _BLOCK):
                if (part := count[:, i : i + _BLOCK]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i // _BLOCK], pa.int32()), pa.array([small.compress(part.astype(np.int64).tobytes())], pa.binary())], names=["k", "block", "data"])

    def total(table: pa.Table) -> np.ndarray:
        large = zstandard.ZstdDecompressor()
        out = np.zeros((2, _BLOCK), np.int64)
        for x in table.column("data").to_pylist():
            out += np.frombuffer(large.decompress(x), np.int64).reshape(2, _BLOCK)
        return out

    def row(table: pa.Table, data: bytes) -> pa.Table:
        return pa.table([table.column("k").slice(0, 1), table.column("block").slice(0, 1), pa.array([data], pa.binary())], names=["k", "block", "data"])

    def add(table: pa.Table) -> pa.Table:
        return row(table, zstandard.ZstdCompressor(level=1).compress(total(table).tobytes()))

    def finish(table: pa.Table) -> pa.Table:
        return row(table, logit(*total(table)).astype(np.float16).tobytes())

    blocks = texts.select("text").mapInArrow(run, _BLOCKS)
    if salts > 1:
        blocks = blocks.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("k", "block", "salt").applyInArrow(add, _BLOCKS)
    tables = [np.zeros(1 << b, np.float16) for b in sizes]
    for r in blocks.groupBy("k", "block").applyInArrow(finish, _BLOCKS).collect():
        tables[r["k"]][r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(bytes(r["data"]), np.float16)
    return tables


class Tuner:
    """Mixing weights, moved against the error of each stretch after it was predicted."""

    def __init__(self, code: Code, tables: list[np.ndarray]) -> None:
        self.code, self.tables = code, tables
        self.sizes = tuple(len(t).bit_length() - 1 for t in tables)
        self.weights = np.tile(START, (GATES, 1)).astype(np.float64)
        self.seen = 0

    def __call__(self, texts: list[bytes]) -> float:
        """Take a stretch of texts; its bits under the weights before the move."""
        keys, at = distinct(grams(*symbols_of(texts)))
        bits = Bits(self.code, self.sizes, keys)
        n = np.bincount(at, minlength=len(keys))[bits.of].astype(np.float64)
        logits = [t[slot].astype(np.float64) for t, slot in zip(self.tables, bits.slots, strict=True)]
        z = sum(self.weights[bits.gate, k] * x for k, x in enumerate(logits))
        p = 1 / (1 + np.exp(-z))
        error, spread = n * (bits.bit - p), n * p * (1 - p)
        for k, x in enumerate(logits):
            push = np.bincount(bits.gate, error * x, GATES) / (np.bincount(bits.gate, spread * x * x, GATES) + 1000)
            self.weights[:, k] += STEP * push.clip(-0.5, 0.5)
        self.seen += int(n.sum())
        return float((n * np.logaddexp(0, np.where(bits.bit > 0, -z, z))).sum() / math.log(2))


def stretches(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Neighbouring texts of about ``size`` bytes together; a longer one alone."""
    now: list[bytes] = []
    for text in texts:
        if now and sum(map(len, now)) + len(text) > size:
            yield now
            now = []
        now.append(text)
    if now:
        yield now


def tuned_weights(texts: DataFrame, model, shards: int) -> np.ndarray:
    """Weights learned online in each shard of (text, mark), averaged by bits; shards and their order follow the mark."""

    def run(table: pa.Table) -> pa.Table:
        tuner = Tuner(*model.value)
        order = sorted(zip(table.column("mark").to_pylist(), byte_texts(table.select(["text"]).combine_chunks().to_batches()[0], "text"), strict=True))
        for part in stretches([t for _, t in order], MOVE_BYTES):
            tuner(part)
        return pa.table({"mark": pa.array([order[0][0]], pa.int64()), "n": pa.array([tuner.seen], pa.int64()), "data": pa.array([tuner.weights.tobytes()], pa.binary())})

    dealt = texts.select("text", "mark", F.pmod(F.shiftright("mark", 8), F.lit(shards)).cast("int").alias("shard"))
    rows = sorted(dealt.groupBy("shard").applyInArrow(run, "mark bigint, n bigint, data binary").collect(), key=lambda r: r["mark"])
    total = sum(r["n"] for r in rows)
    if not total:
        return np.tile(START, (GATES, 1))
    return (sum(np.frombuffer(bytes(r["data"]), np.float64) * r["n"] for r in rows) / total).reshape(GATES, len(ORDERS)).astype(np.float32)


def text_bits(code: Code, tables: list[np.ndarray], weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Bits of each text (end included) under the mixed predictors."""
    symbols, lengths = symbols_of(texts)
    keys, at = distinct(grams(symbols, lengths))
    bits = Bits(code, tuple(len(t).bit_length() - 1 for t in tables), keys)
    z = np.zeros(len(bits.of), np.float32)
    for k, (table, slot) in enumerate(zip(tables, bits.slots, strict=True)):
        z += weights[bits.gate, k] * table[slot]
    z = np.where(bits.bit > 0, z, -z)
    flat, sharp = (np.add.reduceat(-softplus(-np.float32(g) * z), bits.first)[at] for g in GAINS)
    starts = np.cumsum(lengths) - lengths
    n = -(-lengths // STRETCH)  # stretches of each text
    first = np.cumsum(n) - n
    cuts = np.repeat(starts, n) + STRETCH * (np.arange(n.sum()) - np.repeat(first, n))
    lead = np.add.reduceat(sharp - flat, cuts, dtype=np.float64)  # of the sharper mix over the flatter one
    past = np.cumsum(lead) - lead
    past = (past - np.repeat(past[first], n)).astype(np.float32)
    size = np.diff(np.append(cuts, len(symbols)))
    flat -= np.repeat(softplus(past), size)
    sharp -= np.repeat(softplus(-past), size)
    mixed = np.maximum(flat, sharp) + np.log1p(np.exp(-np.abs(flat - sharp)))
    return -np.add.reduceat(mixed, starts, dtype=np.float64) / math.log(2)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0)


def base_sums(texts: DataFrame, groups: int, buckets: int) -> DataFrame:
    """For each row its two signatures, the sum of log10(c + 0.1) over its words, and known words.

    Word groups know the counts; they answer with packed partial sums by bucket of the row, which are
    added up there. Of a word that is common in a chunk the group gets one count for the chunk, and answers the
    chunk; how often each row has it goes straight to the bucket of the chunk's rows (numbered from ``groups`` on). A row
    without signature has the training words and the distinct ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            every = np.array(batch.column("row").to_pylist(), np.int64)
            held = np.array(batch.column("held_out").to_pylist(), bool)
            signs = [np.array(batch.column(c).to_pylist(), np.int64).view(np.uint64) for c in ("sign", "sign2")]
            words = [np.unique(hasher(text.translate(_LOWER).split()), return_counts=True) for text in byte_texts(batch, "text")]
            lots = every // LOT_ROWS
            for lot in np.unique(lots):
                mine = np.flatnonzero(lots == lot)
                rows = every[mine]
                bucket = np.full(len(rows), groups + _bucket(int(lot), buckets), np.int64)
                yield packed.pack(bucket, rows, signs[0][mine], _SIGN, second=signs[1][mine], second_width=8)
                sizes = np.array([len(words[i][0]) for i in mine], np.int64)
                owner, value, n = np.repeat(rows, sizes), np.concatenate([words[i][0] for i in mine]), np.concatenate([words[i][1] for i in mine])
                if not len(value):
                    continue
                train = np.where(np.repeat(held[mine], sizes), 0, n)
                order, number = packed.classes(value)
                common = np.bincount(number) >= COMMON
                lead = order[np.flatnonzero(np.diff(number, prepend=-1))]
                place = np.empty(len(value), np.int64)
                place[order] = number
                alone = ~common[place]
                time = n.astype(np.uint64) * np.uint64(2) + (train > 0)
                yield packed.pack(_group(value[alone], groups), owner[alone], value[alone], _WORD, second=time[alone])
                if common.any():
                    total = np.bincount(place, train).astype(np.uint64)
                    which = lead[common]
                    yield packed.pack(_group(value[which], groups), np.full(len(which), rows[0], np.int64), value[which], _COMMON, second=total[common], second_width=8)
                    index = np.cumsum(common) - 1  # common words of the lot in the order of their hashes
                    own = ~alone
                    yield packed.pack(np.full(int(own.sum()), bucket[0]), owner[own], (index[place[own]].astype(np.uint64) << np.uint64(24)) | np.minimum(n[own], (1 << 24) - 1).astype(np.uint64), _HELD, 6)
                    far = own & (n >= 1 << 24)
                    if far.any():  # more of a word than fits: the rest again
                        left = n[far].astype(np.uint64) - np.uint64((1 << 24) - 1)
                        yield packed.pack(np.full(int(far.sum()), bucket[0]), owner[far], index[place[far]].astype(np.uint64), _TIMES, second=left, second_width=8)

    def look_up(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        if group >= groups:  # by bucket already
            return table.set_column(0, "grp", pa.array(np.full(table.num_rows, group - groups, np.int32)))
        owners, words, times = packed.unpack_two(table, _WORD)
        lots, shared, totals = packed.unpack_two(table, _COMMON, 8, 8)
        n, train = (times >> np.uint64(1)).astype(np.int64), (times & np.uint64(1)).astype(bool)
        every = np.concatenate([words, shared])
        if not len(every):
            return packed.empty()
        order, number = packed.classes(every)
        c = np.bincount(number, np.concatenate([np.where(train, n, 0), totals.astype(np.int64)])[order])
        own = np.empty(len(every), np.float64)
        own[order] = c[number]
        rows, at = np.unique(owners, return_inverse=True)
        mine, counts = own[: len(words)], own[len(words) :]
        logs = np.bincount(at, n * np.log10(mine + 0.1), len(rows))
        known = np.bincount(at, np.where(mine > 0, n, 0), len(rows)).astype(np.uint64)
        out = [packed.pack(_buckets(rows // LOT_ROWS, buckets), rows, logs.view(np.uint64), _SUMS, second=known, second_width=8)]
        back = np.lexsort((shared, lots))
        out.append(packed.pack(_buckets(lots[back] // LOT_ROWS, buckets), lots[back], shared[back], _COMMON, second=counts[back].astype(np.uint64), second_width=8))
        out.append(packed.pack(np.zeros(2, np.int64), np.arange(2), np.array([c.sum(), (c > 0).sum()]).astype(np.uint64), _TOTALS))
        return pa.Table.from_batches(out)

    def add(table: pa.Table) -> pa.Table:
        rows, names, more = packed.unpack_two(table, _SIGN, 8, 8)
        order = np.argsort(rows)
        rows, names, more = rows[order], names[order], more[order]
        owners, logs, known = packed.unpack_two(table, _SUMS, 8, 8)
        at = np.searchsorted(rows, owners)
        sums, knowns = np.bincount(at, logs.view(np.float64), len(rows)), np.bincount(at, known.astype(np.float64), len(rows))
        lots, shared, counts = packed.unpack_two(table, _COMMON, 8, 8)
        order = np.lexsort((shared, lots))  # common words of a lot in the order of their hashes
        lots, counts = lots[order], counts[order].astype(np.float64)
        held, value = packed.unpack(table, _HELD, 6)
        far = packed.unpack_two(table, _TIMES, 8, 8)
        owner, index = np.concatenate([held, far[0]]), np.concatenate([value >> np.uint64(24), far[1]]).astype(np.int64)
        n = np.concatenate([(value & np.uint64((1 << 24) - 1)).astype(np.float64), far[2].astype(np.float64)])
        firsts = np.unique(lots)  # a part of a lot is named by its first row
        mine = firsts[np.searchsorted(firsts, owner, side="right") - 1] if len(owner) else owner
        c = counts[np.searchsorted(lots, mine) + index] if len(owner) else np.empty(0)
        at = np.searchsorted(rows, owner)
        sums = sums + np.bincount(at, n * np.log10(c + 0.1), len(rows))
        knowns = knowns + np.bincount(at, np.where(c > 0, n, 0), len(rows))
        columns = [names.view(np.int64).tolist(), more.view(np.int64).tolist(), sums.tolist(), knowns.astype(np.int64).tolist(), [0] * len(rows)]
        kind, totals = packed.unpack(table, _TOTALS)
        if len(kind):
            for column, x in zip(columns, (None, None, 0.0, int(totals[kind == 0].sum()), int(totals[kind == 1].sum())), strict=True):
                column.append(x)
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["sign", "sign2", "logs", "known", "words"])

    numbered = texts.select("sign", "sign2", "held_out", "text", F.monotonically_increasing_id().alias("row"))
    answers = numbered.mapInArrow(run, packed.SCHEMA).groupBy("grp").applyInArrow(look_up, packed.SCHEMA)
    return answers.groupBy("grp").applyInArrow(add, "sign bigint, sign2 bigint, logs double, known bigint, words bigint")


def _group(words: np.ndarray, groups: int) -> np.ndarray:
    return (words % np.uint64(groups)).astype(np.int64)


def _buckets(lots: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(lots.astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _bucket(lot: int, buckets: int) -> int:
    return int(_buckets(np.array([lot]), buckets)[0])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row.

    Training texts are those whose crc32 of the id as text is not 0 modulo ``parts``. ``base_score``
    is the smoothed unigram model over words (A-Z lower-cased) and an end; ``score`` is the log10
    probability of the bytes and the end under the mixed predictors. Null and empty texts are an end
    only. Rows are scored one by one, also if ids or whole rows repeat. If no text is for training,
    counts are 0 and predictors say nothing. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", fold(F.col("doc_id"), parts) == 0)
    texts = texts.withColumn("sign", F.xxhash64("doc_id", "text")).withColumn("sign2", F.xxhash64("text", "doc_id", F.lit(1)))
    counts = byte_counts(texts)
    code = Code(counts)
    ends, train_bytes = int(counts[END]) - 1, int(counts.sum())
    learned = texts.filter("not held_out").select("text", F.xxhash64(F.lit(3), "text").alias("mark"))
    tuning = F.pmod("mark", F.lit(TUNING)) == 0
    tables = count_tables(learned.filter(~tuning), code, table_bits(train_bytes), math.ceil(math.sqrt(train_bytes / (128 << 20))))
    weights = tuned_weights(learned.filter(tuning), spark.sparkContext.broadcast((code, tables)), max(1, math.ceil(train_bytes / TUNING / SHARD_BYTES)))
    model = spark.sparkContext.broadcast((code, tables, weights))
    groups = max(128, math.ceil(train_bytes / 10 / 1_000_000))  # few would make answers grow faster than the input
    buckets = max(math.ceil(ends / 20_000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = written(base_sums(texts, groups, buckets), "base")
    n, v = (x or 0 for x in sums.filter("sign is null").agg(F.sum("known"), F.sum("words")).first())
    train_tokens, distinct = n + ends, v + (ends > 0)
    norm = math.log10(train_tokens + 0.1 * (distinct + 1))
    per_text = sums.filter("sign is not null").groupBy("sign", "sign2").agg(F.max("logs").alias("logs"), F.max("known").alias("known"))  # equal rows have equal sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, weights = model.value
        tables = [t.astype(np.float32) for t in tables]
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            texts = byte_texts(batch, "text")
            bits = text_bits(code, tables, weights, texts)
            n = [len(t.split()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("sign"), batch.column("sign2"), pa.array(n, pa.int64()), pa.array(-bits * math.log10(2), pa.float64()), pa.array(bits / np.maximum(1, list(map(len, texts))), pa.float64())], names=["doc_id", "held_out", "sign", "sign2", "n", "score", "bits_per_byte"])

    scored = texts.select("doc_id", "held_out", "sign", "sign2", "text").mapInArrow(run, "doc_id bigint, held_out boolean, sign bigint, sign2 bigint, n bigint, score double, bits_per_byte double")
    return scored.join(per_text, ["sign", "sign2"], "left").select(
        "doc_id",
        "held_out",
        (F.col("n") + 1).alias("n_tokens"),
        (F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.coalesce("logs", F.lit(0.0)) + math.log10(ends + 0.1) - (F.col("n") + 1) * norm).alias("base_score"),
        "score",
        "bits_per_byte",
    )
