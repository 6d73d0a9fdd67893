"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

A text that compresses far better than prose of its length is repetitive, one that compresses far
worse is noise. The limits depend on the length, since a short text has little to refer back to. A
document is judged as a whole and by its chunks of ``chunk_bytes``, the last one by the limits of its
own length: a repetitive or incompressible part within a long text shows only there, and one such
chunk is enough. All of it is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import add_rest, byte_texts, carried, id_and_text, rebatched, with_rest

SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, n_chunks int, n_odd_chunks int"
#: All bytes but those that continue a UTF-8 code point.
_NOT_CONTINUATION = bytes(x for x in range(256) if x & 0xC0 != 0x80)
_LINE_WITH_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]")


@dataclass(frozen=True)
class Bands:
    """Accepted compressed/plain ratios by UTF-8 length: (from bytes, least, most), ascending.

    From the ratios of labelled clean documents: a tenth under the least of them, a twentieth over the most. Where prose of a
    small vocabulary reaches (whole texts from 5,000 bytes, chunks from 3,000) the least is as low as that.
    """

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, 9.0), (100, 0.56, 1.0), (300, 0.47, 0.79), (500, 0.448, 0.765), (1000, 0.415, 0.64), (2000, 0.41, 0.58), (3000, 0.394, 0.543), (5000, 0.365, 0.515), (10_000, 0.33, 0.482), (20_000, 0.315, 0.463))
    chunk: tuple[tuple[int, float, float], ...] = ((0, 0.0, 99.0), (100, 0.554, 1.0), (300, 0.47, 0.79), (500, 0.448, 0.765), (1000, 0.415, 0.64), (2000, 0.41, 0.58), (3000, 0.355, 0.543), (4096, 0.355, 0.54))
    chunk_bytes: int = 4096
    level: int = 3


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words in ``width``-word windows that are found twice or more in the list, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = ids[:n]
    for i in range(1, width):
        if int(key.max()) + 1 > (1 << 62) // len(seen):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(seen) + ids[i : i + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= twice
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if _LINE_WITH_WORD.search(x)]
    return len(lines) - len(set(lines))


def within(limits: tuple[tuple[int, float, float], ...], size: int, ratio: float) -> bool:
    """Whether a ratio is within the limits for the size; below the first limits anything is."""
    _, least, most = next((b for b in reversed(limits) if size >= b[0]), (0, 0.0, math.inf))
    return least <= ratio <= most


def compression_verdict(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[bool, float, int, int]:
    """Whether the text is within its bands; whole ratio, chunks (the last may be shorter), chunks out of band."""
    if not text:
        return True, 0.0, 0, 0
    ratio = len(compressor.compress(text)) / len(text)
    chunks = [text[i : i + bands.chunk_bytes] for i in range(0, len(text), bands.chunk_bytes)]
    ratios = [len(compressor.compress(c)) / len(c) for c in chunks] if len(chunks) > 1 else [ratio]
    odd = sum(not within(bands.chunk, len(c), x) for c, x in zip(chunks, ratios, strict=True))
    return within(bands.whole, len(text), ratio) and not odd, ratio, len(chunks), odd


def judge(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    """The columns of ``SCHEMA`` after the id."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - len(text.translate(None, _NOT_CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeated = repeat_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    fits, ratio, chunks, odd = compression_verdict(text, bands, compressor)
    return n, chars, symbols, dup_lines(text), repeated, failed, fits and not failed, ratio, chunks, odd


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(), carry: bool = False) -> DataFrame:
    """One row per input row with its counts, its compression figures and ``kept``.

    Null and empty texts have no words and fail the base rule (fewer than 50 words). Repeated rows
    are judged one by one; a null id is passed on. An empty table gives no rows. Other columns are
    not read; with ``carry`` the text and a struct ``rest`` of them follow.
    """
    own = id_and_text(docs, id_col, text_col, *(carried(docs, text_col) if carry else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in rebatched(batches, "text"):
            rows = [judge(t, bands, compressor) for t in byte_texts(batch, "text")]
            columns = [batch.column("doc_id"), *map(list, zip(*rows, strict=True))]
            yield add_rest(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES), batch)

    return own.mapInArrow(run, with_rest(SCHEMA, own))


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}[x.split()[1]] for x in SCHEMA.split(", ")]
