"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a logistic model under the
non-negative unbiased risk: prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]). Labels of 0 are not used. The
class prior is estimated from positives and unlabelled texts alone: a model that tells the two apart is fitted on half of the
rows, and on the other half the least ratio of unlabelled to positive texts above a threshold, less two standard errors and a margin,
bounds the share of positives among the unlabelled (too large a prior costs more than too small a one). Features are hashed words and hashed runs of
four bytes, as square roots of their shares, and shares and rates of the text's characters, words and lines, each cut into bins at quantiles.

All rows of the training fold are used. Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of the id and kept as packed
features, a row of the shared table for each shard, so a text is read once, to learn from and to be scored. In each of ``ROUNDS`` every shard goes ``STEPS`` steps from the common weights,
and the shards' weights are averaged by rows. The driver holds weights, quantiles and a histogram of fixed size, no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, id_and_text, rebatched, spread, written

#: Rows of a shard, about (four in five are learned from), and tasks that shards are dealt to at most.
SHARD_ROWS, MOST_TASKS = 2560, 4096
BINS = 12
#: Slots of the hashed words, and of the hashed runs of bytes.
SLOTS = 1 << 12
#: Chosen on texts of the training fold whose remainder is 1, by models of the others.
ROUNDS, STEPS, ROWS, RATE, DECAY = 2, 150, 128, 0.1, 1e-5
#: Part of the estimated prior that is used: the estimate is too large where the kinds overlap, and then junk is let through. Chosen likewise.
MARGIN = 0.945
#: Cells of the histogram of logits, and the logits at its ends.
CELLS, EDGE = 4096, 40.0
NAMES = ("bytes", "words", "word_len", "distinct", "top_word", "adjacent", "odd_word", "symbols", "pipes", "bangs", "upper", "digits", "punct", "other", "space", "line_len", "dup_lines", "longest", "ratio", "short_words", "ends")
_KINDS = {"symbols": b"#*$%&<>", "pipes": b"|", "bangs": b"!?", "upper": bytes(range(65, 91)), "digits": b"0123456789", "punct": b".,;:'\"()-", "lower": bytes(range(97, 123)), "space": b" \t\n\x0b\x0c\r"}
_KIND = np.zeros(256, np.uint8)
for _n, _chars in enumerate(_KINDS.values(), 1):
    _KIND[list(_chars)] = _n
_SPACE = _KIND == list(_KINDS).index("space") + 1
_ODD_END = np.array([c < 128 and not chr(c).isalnum() and chr(c) not in ".,;:!?'\")" for c in range(256)])


def features(text: bytes) -> np.ndarray:
    """The numbers of ``NAMES``; all 0 but for an empty text's sizes."""
    size = len(text)
    if not size:
        return np.zeros(len(NAMES), np.float32)
    raw = np.frombuffer(text, np.uint8)
    has = dict(zip(_KINDS, np.bincount(_KIND[raw], minlength=len(_KINDS) + 1)[1:].tolist(), strict=True))
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    last, lengths = raw[ends - 1], ends - starts
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = text.split(b"\n")
    letters = max(1, has["upper"] + has["lower"])
    return np.array([
        np.log1p(size), np.log1p(len(words)), (size - has["space"]) / n, len(seen) / n, max(seen.values(), default=0) / n, sum(map(eq, words, words[1:])) / n, np.count_nonzero(_ODD_END[last]) / n,
        has["symbols"] / n, has["pipes"] / n, has["bangs"] / n, has["upper"] / letters, has["digits"] / size, has["punct"] / n,
        1 - (has["upper"] + has["lower"] + has["space"] + has["digits"] + has["punct"]) / size, has["space"] / size,
        np.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(lengths.max(initial=0)),
        len(zlib.compress(text, 1)) / size, np.count_nonzero(lengths < 4) / n, np.count_nonzero(last == 46) / n,
    ], np.float32)


_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def gram_counts(text: bytes) -> np.ndarray:
    """How often each slot of hashed runs of four bytes, then of hashed words, occurs, A-Z lower-cased."""
    text = text.translate(_LOWER)
    out = np.zeros(2 * SLOTS, np.int64)
    if len(text) > 3:
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        code = (b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)) * np.uint32(0x9E3779B1) >> np.uint32(20)
        out[:SLOTS] = np.bincount(code, minlength=SLOTS)
    words = text.split()
    if words:
        out[SLOTS:] = np.bincount(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % SLOTS, minlength=SLOTS)
    return out


def used_slots(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The used slots and the square roots of their shares, of runs and of words each."""
    used = np.flatnonzero(counts)
    total = np.where(used < SLOTS, max(1, counts[:SLOTS].sum()), max(1, counts[SLOTS:].sum()))
    return used, np.sqrt(counts[used] / total)


def packed_counts(counts: np.ndarray, squeeze: Callable[[bytes], bytes]) -> bytes:
    """A bit for each slot, a byte for each used one, four for counts from 255 on."""
    own = counts[counts > 0]
    return squeeze(np.packbits(counts > 0).tobytes() + np.minimum(own, 255).astype(np.uint8).tobytes() + own[own >= 255].astype("<u4").tobytes())


def unpacked_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Used slots and their counts."""
    used = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 2 * SLOTS // 8)))
    own = np.frombuffer(data, np.uint8, len(used), 2 * SLOTS // 8).astype(np.int64)
    own[own == 255] = np.frombuffer(data, "<u4", -1, 2 * SLOTS // 8 + len(used))
    return used, own


@dataclass(frozen=True)
class Sample:
    """Texts as their rates (rows of ``NAMES``) and the used slots of their grams, end to end."""

    rates: np.ndarray
    starts: np.ndarray
    slots: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rates: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]) -> Sample:
        starts = np.cumsum([0, *(len(s) for s, _ in grams)])
        join = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)]).astype(kind)
        return cls(rates, starts, join((s for s, _ in grams), np.int64), join((v for _, v in grams), np.float64))

    @classmethod
    def of_texts(cls, texts: list[bytes]) -> Sample:
        rates = np.stack([features(t) for t in texts]) if texts else np.empty((0, len(NAMES)), np.float32)
        return cls.of(rates, [used_slots(gram_counts(t)) for t in texts])

    def __len__(self) -> int:
        return len(self.rates)

    def take(self, rows: np.ndarray) -> Sample:
        sizes = np.diff(self.starts)[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(sizes.sum())
        return Sample(self.rates[rows], np.concatenate(([0], ends)), self.slots[at], self.values[at])


#: Weights of the bins of all rates, of the slots, and the bias.
WIDTH = len(NAMES) * BINS + 2 * SLOTS + 1


@dataclass(frozen=True)
class Model:
    cuts: np.ndarray
    weights: np.ndarray

    def places(self, rates: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, rates.T, strict=True)], 1)
        return bins + np.arange(rates.shape[1]) * BINS

    def logits(self, x: Sample) -> np.ndarray:
        rows = np.repeat(np.arange(len(x)), np.diff(x.starts))
        first = len(NAMES) * BINS
        return self.weights[self.places(x.rates)].sum(1) + np.bincount(rows, self.weights[first + x.slots] * x.values, len(x)) + self.weights[-1]


def risk(f: np.ndarray, g: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative unbiased risk of logistic loss for logits of positives and unlabelled, and its slopes along them.

    Where the negative part would be under 0, the slopes are those that take it up again.
    """
    up, ug = 1 / (1 + np.exp(-f)), 1 / (1 + np.exp(-g))
    positive = prior * np.logaddexp(0, -f).mean()
    negative = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, f).mean()
    at_p, at_u = -prior * up / len(f), ug / len(g)
    if negative < 0:
        return positive, -at_p, -at_u
    return positive + negative, at_p + prior * (up - 1) / len(f), at_u


def against(f: np.ndarray, g: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss that tells positives from unlabelled, each half of the weight, and its slopes."""
    up, ug = 1 / (1 + np.exp(-f)), 1 / (1 + np.exp(-g))
    return (np.logaddexp(0, -f).mean() + np.logaddexp(0, g).mean()) / 2, (up - 1) / len(f) / 2, ug / len(g) / 2


def quantiles(rates: np.ndarray) -> np.ndarray:
    """Ends of the bins of each rate; junk is rare, so the tails have bins of their own."""
    cuts = np.quantile(rates, np.arange(1, BINS) / BINS, axis=0).T
    tails = np.quantile(rates, [0.02, 0.98], axis=0).T
    cuts[:, 0], cuts[:, -1] = tails[:, 0], tails[:, 1]
    return np.sort(cuts, axis=1)


def fit(positive: Sample, unlabelled: Sample, start: Model, prior: float, loss=risk, steps: int = STEPS, seed: int = 1) -> np.ndarray:
    """Weights after ``steps`` of Adam from ``start``, each over ``ROWS`` rows of both kinds in an order that follows the seed; the mean of the last half."""
    width, n = len(NAMES), len(NAMES) * BINS
    rng = np.random.default_rng(seed)
    ready = []
    for x in (positive, unlabelled):
        x = x.take(rng.permutation(len(x)))
        ready.append((x, start.places(x.rates)))
    w = start.weights.copy()
    m, v, mean = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w))
    decay = np.append(np.full(len(w) - 1, DECAY), 0.0)

    def draw(kind: int, step: int) -> tuple:
        x, at = ready[kind]
        size = min(ROWS, len(at))
        a = step * size % (len(at) - size + 1)
        ends = x.starts[a : a + size + 1]
        return at[a : a + size], x.slots[ends[0] : ends[-1]], x.values[ends[0] : ends[-1]], ends - ends[0]

    def logits(at: np.ndarray, slots: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(np.append(w[n:-1][slots] * values, 0.0), ends[:-1])  # of a row without grams it is the next one's first term
        return np.clip(w[at].sum(1) + np.where(ends[1:] > ends[:-1], sums, 0.0) + w[-1], -700, 700)

    def push(part: tuple, slope: np.ndarray) -> np.ndarray:
        at, slots, values, ends = part
        return np.concatenate([np.bincount(at.ravel(), np.repeat(slope, width), n), np.bincount(slots, values * np.repeat(slope, np.diff(ends)), 2 * SLOTS), [slope.sum()]])

    for step in range(1, steps + 1):
        p, u = draw(0, step), draw(1, step)
        _, at_p, at_u = loss(logits(*p), logits(*u), prior)
        grad = push(p, at_p) + push(u, at_u) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if 2 * step > steps:
            mean += w
    return mean / (steps - steps // 2)


def histogram(logits: np.ndarray) -> np.ndarray:
    """Counts of logits by ``CELLS`` cells between the edges; what lies beyond is in the last cells."""
    cell = np.clip(((logits + EDGE) * (CELLS / (2 * EDGE))).astype(np.int64), 0, CELLS - 1)
    return np.bincount(cell, minlength=CELLS)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from histograms of both alone: a lower bound by two standard errors, and ``MARGIN`` of that.

    Above any threshold the unlabelled have at least the positives' share times the prior, so the least ratio over all
    thresholds, with an allowance for chance, is taken.
    """
    n, k = positive.sum(), unlabelled.sum()
    if not n or not k:
        return 0.5
    share_p, share_u = np.cumsum(positive[::-1]) / n, np.cumsum(unlabelled[::-1]) / k
    some = share_p > 0
    share_p, share_u = share_p[some], share_u[some]
    slack = math.sqrt(math.log(40) / 2 / n) + math.sqrt(math.log(40) / 2 / k)
    best = int(np.argmin((share_u + slack) / share_p))
    p, u = share_p[best], share_u[best]
    low = MARGIN * (u - 2 * math.sqrt(u * (1 - u) / k)) / (p + 2 * math.sqrt(p * (1 - p) / n))
    return float(min(0.99, max(0.01, low)))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


_PACKED = "shard int, n bigint, ids array<bigint>, held binary, positive binary, rates binary, sizes binary, slots binary, counts binary, cuts binary"


def packed_shards(texts: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """A row for each shard with the packed features of its texts, whether each is held out and whether it is positive.

    ``texts`` has (doc_id, text, held_out), ``known`` doc_id of the positives. Rows of a shard are ordered by id and content, so it does not matter
    in which order they came. Bins are of the rows that are not held out.
    """
    shard = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(shards)).cast("int").alias("shard")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in rebatched(batches, "text"):
            own = byte_texts(batch, "text")
            rates = pa.array([features(t).tobytes() for t in own], pa.binary())
            grams = pa.array([packed_counts(gram_counts(t), squeeze) for t in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), batch.column("held_out"), rates, grams], names=["shard", "doc_id", "held_out", "rates", "grams"])

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(*(left.column(c).to_pylist() for c in ("doc_id", "held_out", "rates", "grams")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
        one: list[object] = []
        if rows:
            ids, held, rates, grams = zip(*rows, strict=True)
            trusted, undo, squeeze = set(right.column("doc_id").to_pylist()), zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
            held_out = np.array(held)
            matrix = np.frombuffer(b"".join(rates), np.float32).reshape(-1, len(NAMES))
            parts = [unpacked_counts(undo(g)) for g in grams]
            slots = np.concatenate([np.diff(u, prepend=0) for u, _ in parts]).astype("<u2")
            counts = np.concatenate([c for _, c in parts]).astype("<u4")
            sizes = np.array([len(u) for u, _ in parts], "<u4")
            cuts = quantiles(matrix[~held_out]) if not held_out.all() else np.empty((0, 0))
            positive = np.array([i in trusted for i in ids])
            one = [left.column("shard")[0].as_py(), len(rows), list(ids), held_out.tobytes(), positive.tobytes(), matrix.tobytes(), sizes.tobytes(), squeeze(slots.tobytes()), squeeze(counts.view(np.uint8).reshape(-1, 4).T.tobytes()), cuts.tobytes()]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 7]
        return pa.table([pa.array([v] if rows else [], t) for v, t in zip(one or [None] * len(kinds), kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

    extracted = texts.select("doc_id", "text", "held_out", shard).mapInArrow(extract, "shard int, doc_id bigint, held_out boolean, rates binary, grams binary").repartition(min(shards, MOST_TASKS), "shard")
    packed = extracted.groupBy("shard").cogroup(known.select("doc_id", shard).groupBy("shard")).applyInArrow(pack, _PACKED)
    return written(packed, "shards")


def _sample_of(row: dict) -> Sample:
    """The features of a packed shard."""
    undo = zstandard.ZstdDecompressor().decompress
    sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    steps = np.frombuffer(undo(row["slots"]), "<u2").astype(np.int64)
    planes = np.frombuffer(undo(row["counts"]), np.uint8).reshape(4, -1)
    counts = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    run = np.cumsum(steps)
    slots = run - np.repeat(np.where(sizes > 0, np.append(run, 0)[starts[:-1] - 1] * (starts[:-1] > 0), 0), sizes)
    part = 2 * np.repeat(np.arange(len(sizes)), sizes) + (slots >= SLOTS)
    totals = np.bincount(part, counts, 2 * len(sizes))
    return Sample(np.frombuffer(row["rates"], np.float32).reshape(-1, len(NAMES)), starts, slots, np.sqrt(counts / totals[part]))


def _sums(shards: DataFrame, work: Callable[[int, Sample | None, Sample | None, np.ndarray], np.ndarray]) -> tuple[np.ndarray, float]:
    """The sum over shards of ``work(shard, positives, unlabelled, cuts)``, by rows, and the rows; shards without two positives are left out.

    Without the columns of the features ``work`` gets no samples.

    Tasks add up their own shards, and a few tasks add up theirs, so the driver gets sixteen vectors at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, last = None, 0, 0
        for batch in batches:
            for one in batch.to_pylist():
                learn = ~np.frombuffer(one["held"], bool)
                trusted = learn & np.frombuffer(one["positive"], bool)
                if trusted.sum() > 1:
                    every = _sample_of(one) if "slots" in one else None
                    kinds = [every and every.take(np.flatnonzero(x)) for x in (trusted, learn)]
                    vector = work(one["shard"], *kinds, np.frombuffer(one["cuts"], np.float64)) * learn.sum()
                    total, rows, last = vector if total is None else total + vector, rows + int(learn.sum()), one["shard"]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last % 16], pa.int32()), pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "vector"])

    def add(table: pa.Table) -> pa.Table:
        vectors = sorted(table.column("vector").to_pylist())
        total = np.sum([np.frombuffer(v) for v in vectors], axis=0)
        return pa.table([pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "vector"])

    rows = shards.drop("ids", "n").mapInArrow(run, "part int, n bigint, vector binary").groupBy("part").applyInArrow(add, "n bigint, vector binary").collect()
    if not rows:
        return np.empty(0), 0.0
    return np.sum([np.frombuffer(v) for v in sorted(bytes(r["vector"]) for r in rows)], axis=0), float(sum(r["n"] for r in rows))


def train(shards: DataFrame) -> Model | None:
    """The model of the rows of packed shards that are not held out; none without two positives in any shard."""
    cuts, rows = _sums(shards.select("shard", "held", "positive", "cuts"), lambda shard, p, u, cuts: cuts)
    if not rows:
        return None
    cuts = (cuts / rows).reshape(len(NAMES), BINS - 1).astype(np.float32)

    def step(model: Model, prior: float, loss: Callable, half: int | None, seed: int) -> Model:
        def work(shard: int, positive: Sample, unlabelled: Sample, _: np.ndarray) -> np.ndarray:
            some = [x if half is None else x.take(np.arange(half, len(x), 2)) for x in (positive, unlabelled)]
            return fit(*some, model, prior, loss, STEPS, seed + shard)

        total, n = _sums(shards, work)
        return Model(cuts, total / n)

    start = Model(cuts, np.zeros(WIDTH))
    apart = step(start, 0.5, against, 0, 1)
    counts, _ = _sums(shards, lambda shard, p, u, _: np.concatenate([histogram(apart.logits(x.take(np.arange(1, len(x), 2)))) for x in (p, u)]) / len(u))
    prior = estimated_prior(np.rint(counts[:CELLS]), np.rint(counts[CELLS:]))
    model = Model(cuts, np.append(np.zeros(WIDTH - 1), math.log(prior / (1 - prior))))
    for k in range(ROUNDS):
        model = step(model, prior, risk, None, (k + 2) << 32)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", parts: int = 5, threshold: float = 0.3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Labels are learned only from ids whose crc32 as text is not 0 modulo ``parts``; an id with both
    labels is no positive, null labels and ids are left out. Null and empty texts are scored as texts of
    no length. Without two positives every score is 0.5. Repeated rows are scored one by one; an
    empty table gives no rows. Other columns are not read.
    """
    texts = spread(id_and_text(docs, id_col, text_col)).withColumn("held_out", fold(F.col("doc_id"), parts) == 0)
    own = labels.select(F.col(f"`{label_id}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = own.filter((fold(F.col("doc_id"), parts) != 0) & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label")).filter("label = 1")
    shards = packed_shards(texts, known, max(1, round(docs.select(F.lit(1)).count() / shard_rows)))
    shared = docs.sparkSession.sparkContext.broadcast(train(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                score = 1 / (1 + np.exp(-np.clip(shared.value.logits(_sample_of(one)), -700, 700))) if shared.value else np.full(one["n"], 0.5)
                yield pa.RecordBatch.from_arrays([pa.array(one["ids"], pa.int64()), pa.array(np.frombuffer(one["held"], bool)), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return shards.drop("positive", "cuts").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
