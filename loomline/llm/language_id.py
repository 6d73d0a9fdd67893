"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``WIDTH`` signs, made from its code point alone. Three letters in a row are bound: the vectors of the
first and the second are permuted (rotated by two places and by one), and all three are multiplied. The bound vectors of a text are bundled (added), a language's prototype
is the bundle of all its training texts, and a document gets the language whose prototype has the largest cosine with its own bundle.

Bundles are sums of whole numbers, so the prototypes do not depend on how rows are dealt to tasks. A task bundles its own
texts and hands on one vector for each language, which are summed by (lang, place); a language with a third of all rows sends no more than others.
Prototypes are broadcast ``LANGUAGES`` at a time; more than these are met block after block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, rebatched, str_texts, written
from .pu_classifier import fold

#: Signs of a vector. Chosen on training folds, see README.
WIDTH = 1024
#: Prototypes that a worker holds at most (of 8 * WIDTH bytes each).
LANGUAGES = 512
CHUNK_BYTES = 1 << 20
#: Different letter triples in a matrix at a time.
BLOCK = 8192
SEED = 13


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(4096)
def letter_vector(code: int, width: int = WIDTH) -> np.ndarray:
    """The signs of a letter; 0 is what stands before and after a word."""
    return np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, width, np.int8) * np.int8(2) - np.int8(1)


def bound(triples: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The vectors of letter triples (rows of three code points)."""
    codes, place = np.unique(triples, return_inverse=True)
    place = place.reshape(triples.shape)
    vectors = np.stack([letter_vector(int(c), width) for c in codes])
    return np.roll(vectors, 2, 1)[place[:, 0]] * np.roll(vectors, 1, 1)[place[:, 1]] * vectors[place[:, 2]]


def triples_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the triple, and the different triples, for every run of three within a word and its borders."""
    joined = "\0\0".join(texts) + "\0"
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    # lower() may lengthen a text, so rows are told by the separators, which occur only there once others are blanked
    sizes = np.array([len(t.lower()) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes + 2)[: len(codes)]
    codes = np.where(_letters()[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (row[1:] != row[:-1])
    codes, row = codes[keep], row[keep]
    codes, row = np.concatenate([[0], codes]), np.concatenate([[0], row])
    middle = np.flatnonzero(codes[1:-1]) + 1
    alphabet, small = np.unique(codes, return_inverse=True)
    n = len(alphabet)
    key = (small[middle - 1] * n + small[middle]) * n + small[middle + 1]
    if n**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(key, minlength=1))
        number = np.searchsorted(used, key) if len(used) < 2 else np.zeros(int(used[-1]) + 1, np.int64)
        if len(used) >= 2:
            number[used] = np.arange(len(used))
            number = number[key]
    else:
        used, number = np.unique(key, return_inverse=True)
    return row[middle], number, alphabet[np.stack([used // n // n, used // n % n, used % n], 1)]


def bundles(rows: np.ndarray, number: np.ndarray, triples: np.ndarray, n: int, width: int = WIDTH) -> np.ndarray:
    """The bundle of each of ``n`` rows, whole numbers as doubles."""
    out = np.zeros((n, width))
    for at in range(0, len(triples), BLOCK):
        size = min(BLOCK, len(triples) - at)
        inside = (number >= at) & (number < at + size) if len(triples) > BLOCK else slice(None)
        counts = np.bincount(rows[inside] * size + number[inside] - at, minlength=n * size).reshape(n, size)
        kind = np.float32 if counts.sum(1).max(initial=0) < 1 << 24 else np.float64  # sums stay exact
        out += counts.astype(kind) @ bound(triples[at : at + size], width).astype(kind)
    return out


def prototypes(learning: DataFrame, width: int = WIDTH) -> DataFrame:
    """(lang, place, total): the bundle of all texts of each language. ``learning`` has (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            rows, number, triples = triples_of(str_texts(batch, "text"))
            if len(triples):
                of = np.array([names.index(x) for x in langs], np.int64) if len(names) < 50 else np.searchsorted(names, langs)
                for name, total in zip(names, bundles(of[rows], number, triples, len(names), width).astype(np.int64), strict=True):
                    sums[name] = sums[name] + total if name in sums else total
            if len(sums) > LANGUAGES:
                yield _sums(sums, width)
                sums = {}
        yield _sums(sums, width)

    partial = learning.mapInArrow(run, "lang string, totals array<bigint>")
    return partial.select("lang", F.posexplode("totals").alias("place", "total")).groupBy("lang", "place").agg(F.sum("total").alias("total"))


def _sums(sums: dict[str, np.ndarray], width: int) -> pa.RecordBatch:
    values = pa.array(np.concatenate(list(sums.values())) if sums else np.empty(0, np.int64))
    totals = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * width, pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), totals], names=["lang", "totals"])


class Profiles:
    """Prototypes of some languages, to compare texts with."""

    def __init__(self, totals: dict[str, np.ndarray]) -> None:
        self.names = sorted(totals, key=str.encode)
        self.unit = [totals[x] / max(1e-300, np.sqrt((totals[x].astype(np.float64) ** 2).sum())) for x in self.names]

    def nearest(self, texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest prototype (the first of equal ones) and its cosine; -1 without a letter."""
        rows, number, triples = triples_of(texts)
        own = bundles(rows, number, triples, len(texts), width)
        length = np.sqrt((own**2).sum(1))
        best, most = np.full(len(texts), -1), np.full(len(texts), -np.inf)
        for k, unit in enumerate(self.unit):
            cosine = np.divide((own * unit).sum(1), length, out=np.zeros(len(texts)), where=length > 0)
            better = cosine > most
            best[better], most[better] = k, cosine[better]
        best[np.bincount(rows, minlength=len(texts)) == 0] = -1
        return best, most


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, at least 0) of each row.

    Languages are learned from the rows whose id's crc32 as text is not 0 modulo ``parts`` and whose lang is not null; no label
    is used where a row is scored. A text that is null or has no letter is ``und`` with a score of 0, and so is every row when no
    language has a letter to learn from. Of equal cosines the language first by its bytes is taken. Repeated rows are scored one by one, whole
    texts however long; an empty table gives no rows. Other columns are not read.
    """
    texts = id_and_text(docs, id_col, text_col)
    learning = id_and_text(docs, id_col, text_col, F.col(f"`{lang_col}`").cast("string").alias("lang")).filter((fold(F.col("doc_id"), parts) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    learned = written(prototypes(learning.select("text", "lang")), "prototypes")
    order = written(learned.filter("place = 0").select("lang", F.row_number().over(Window.orderBy("lang")).alias("k")), "languages")
    out = texts.select("doc_id", "text", (fold(F.col("doc_id"), parts) == 0).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(-2.0).alias("score"))
    for at in range(0, order.count(), LANGUAGES):
        totals: dict[str, np.ndarray] = {}
        for r in learned.join(order.filter((F.col("k") > at) & (F.col("k") <= at + LANGUAGES)), "lang").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("totals")).toLocalIterator():
            totals[r["lang"]] = np.array([x["total"] for x in r["totals"]], np.int64)
        out = _compared(out, totals)
    return out.select("doc_id", "held_out", "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def _compared(rows: DataFrame, totals: dict[str, np.ndarray]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Profiles(totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text", CHUNK_BYTES):
            best, cosine = shared.value.nearest(str_texts(batch, "text"))
            names, score = batch.column("lang_pred").to_pylist(), batch.column("score").to_numpy().copy()
            for i in np.flatnonzero((best >= 0) & (cosine > score)):
                names[i], score[i] = shared.value.names[best[i]], cosine[i]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "text", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, rows.schema)
