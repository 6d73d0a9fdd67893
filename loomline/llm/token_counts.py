"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a linked list, and its adjacent pairs a heap by merge rank. The
lowest pair is merged until none is left that may be; the count is the initial symbols minus the
merges. No identifiers are made. Counts of pieces already met are kept in a bounded table for each
Python worker. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .byte_bpe import Vocabulary, pieces, vocabulary
from .common import id_and_text, keeps, rebatched, str_texts

#: Pieces whose counts a worker keeps.
KEPT_PIECES = 600_000
_kept: dict[str, dict[str, int]] = {}


def _free() -> None:
    if _kept:
        _kept.clear()
        vocabulary.cache_clear()


keeps("token_counts", _free)


def merges_in(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges the symbols undergo."""
    n = len(symbols)
    find = merges.get
    heap = [(found[0], i, found[1]) for i in range(n - 1) if (found := find((symbols[i], symbols[i + 1])))]
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    done = 0
    while heap:
        _, i, merged = heappop(heap)
        j = after[i]
        if j >= n or symbols[i] < 0 or (found := find((symbols[i], symbols[j]))) is None or found[1] != merged:
            continue  # the pair was there when it was pushed; one of its symbols has changed since
        symbols[i], symbols[j] = merged, -1
        k = after[i] = after[j]
        done += 1
        if k < n:
            before[k] = i
            if found := find((merged, symbols[k])):
                heappush(heap, (found[0], i, found[1]))
        h = before[i]
        if h >= 0 and (found := find((symbols[h], merged))):
            heappush(heap, (found[0], h, found[1]))
    return done


def count_pretoken(token: str, vocab: Vocabulary) -> int:
    symbols = [vocab.first[b] for b in token.encode()]
    return len(symbols) - (merges_in(symbols, vocab.merges) if len(symbols) > 1 else 0)


class Counter:
    """Token counts of texts under one vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.kept = _kept.setdefault(path, {})

    def _learn(self, texts: set[str]) -> None:
        kept, vocab = self.kept, self.vocab
        tokens: dict[str, int] = {}
        for text in texts:
            total = 0
            for t in vocab.pretokens(text):
                if (n := tokens.get(t)) is None:
                    n = tokens[t] = count_pretoken(t, vocab)
                total += n
            kept[text] = total

    def __call__(self, text: str) -> int:
        total = 0
        for part, special in self.vocab.segments(text):
            if special is not None:
                total += 1
                continue
            first, *rest = pieces(part)
            rest = [" " + x for x in rest]
            kept = self.kept
            if new := {first, *rest}.difference(kept):
                self._learn(new)
            total += kept[first] + sum(map(kept.__getitem__, rest))
            if len(kept) > KEPT_PIECES:
                kept.clear()
        return total


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: UTF-8 bytes, tokens, and whether they are more than ``limit``.

    Null and empty texts have 0 bytes and 0 tokens. Strings of added tokens inside a text count as
    one token each, as the format's library does by default. Repeated rows are counted one by one;
    an empty table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocab_path)
        for batch in rebatched(batches, "text", keeper="token_counts"):
            n = [count(t) for t in str_texts(batch, "text")]
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
