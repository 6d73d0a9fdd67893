"""BPE encoding by a pair occurrence index, and decoding.

The different pre-tokens of a lot (all of a partition's texts, or ``LOT_BYTES`` of them if it is larger)
are laid end to end in an array of symbols, ``INDEX_BYTES`` of them at a time. An index maps each adjacent
pair, named by its rank, to all its positions there; the active ranks are applied in ascending order, each to
its whole list at once, and the lists of the pairs next to a merge are updated. Long lists are worked on as
arrays, short ones place by place.
The identifiers of a text are then gathered by position. Nothing is kept from one lot to the next, so
memory is bounded by the lot (or by one text, if that is longer). Encoding, decoding, and the one after the
other are one pass each, without a shuffle.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Vocabulary, pieces, vocabulary
from .common import give_back, id_and_text, rebatched

#: Bytes of text whose pre-tokens are told apart together, bytes of different pre-tokens that share one index, and bytes of text for which results are made at once.
LOT_BYTES = 8 << 20
INDEX_BYTES = 1 << 20
CHUNK_BYTES = 1 << 20
#: A rank with fewer positions is applied place by place.
_FEW = 24
#: A space before any white space: such texts are cut by the slower rule of ``pieces``.
_DOUBLE_SPACE = r" [\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NO_IDS = np.empty(0, np.int32)


class PairIndex:
    """Symbols of many pre-tokens as linked lists, and the positions of each pair by rank."""

    def __init__(self, tokens: list[bytes], vocab: Vocabulary) -> None:
        self.vocab = vocab
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        n = len(raw)
        # arrays of the array module: single places are read much faster than from numpy, which shares the memory
        self.symbols, self.after, self.before = (array("i", bytes(4 * n)) for _ in range(3))
        self.sym, self.aft, self.bef = (np.frombuffer(x, np.int32) for x in (self.symbols, self.after, self.before))
        self.ends = np.cumsum(sizes)
        if not n:
            return
        self.sym[:] = vocab.first_ids[raw]
        self.aft[:] = np.arange(1, n + 1)
        self.bef[:] = np.arange(-1, n - 1)
        self.aft[self.ends - 1] = -1
        self.bef[self.ends - sizes] = -1
        self.index: dict[int, list] = {}
        at = np.flatnonzero(self.aft >= 0).astype(np.int32)
        self._add(vocab.byte_ranks[raw[at], raw[at + 1]], at)
        self.heap = list(self.index)
        heapify(self.heap)

    def _add(self, ranks: np.ndarray, at: np.ndarray) -> list[int]:
        """Enter positions by rank (-1: no pair that may merge); the ranks that were not there."""
        ok = ranks >= 0
        ranks, at = ranks[ok], at[ok]
        if not len(ranks):
            return []
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        new = []
        for rank, a, b in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)], strict=True):
            own = self.index.get(rank)
            if own is None:
                own = self.index[rank] = []
                new.append(rank)
            if b - a < 8:
                own += at[a:b].tolist()
            else:
                own.append(at[a:b])
        return new

    def run(self) -> None:
        """Apply all ranks that occur, in ascending order."""
        heap, index = self.heap, self.index
        while heap:
            rank = heappop(heap)
            lists = index.pop(rank)
            arrays = [x for x in lists if type(x) is not int]
            if not arrays and len(lists) < _FEW:
                self._one_by_one(rank, sorted(lists))
            else:
                alone = [x for x in lists if type(x) is int]
                self._at_once(rank, np.concatenate([np.array(alone, np.int32), *arrays]))

    def _one_by_one(self, rank: int, at: list[int]) -> None:
        symbols, after, before, index, v = self.symbols, self.after, self.before, self.index, self.vocab
        left, right, merged, size, find = v.lefts[rank], v.rights[rank], v.merged[rank], v.size, v.rank_of.get
        for i in at:
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # another merge took one of the two
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (found := find(merged * size + symbols[k])) is not None:
                    self._enter(index, found, i)
            h = before[i]
            if h >= 0 and (found := find(symbols[h] * size + merged)) is not None:
                self._enter(index, found, h)

    def _enter(self, index: dict[int, list], rank: int, at: int) -> None:
        if rank in index:
            index[rank].append(at)
        else:
            index[rank] = [at]
            heappush(self.heap, rank)

    def _at_once(self, rank: int, at: np.ndarray) -> None:
        sym, aft, bef, v = self.sym, self.aft, self.bef, self.vocab
        left, right, merged = v.lefts[rank], v.rights[rank], v.merged[rank]
        j = aft[at]
        at = at[(sym[at] == left) & (j >= 0) & (sym[j] == right)]
        if left == right:  # of a run of the symbol, pairs from the left
            at.sort()
            lead = np.concatenate(([True], at[1:] != aft[at[:-1]])) if len(at) else np.empty(0, bool)
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(lead, place, 0))) % 2 == 0] if len(at) else at
        if not len(at):
            return
        j = aft[at]
        k = aft[j]
        sym[at], sym[j], aft[at] = merged, -1, k
        more = k >= 0
        ahead, nxt = at[more], k[more]
        bef[nxt] = ahead
        h = bef[at]
        h = h[h >= 0]
        h = h[sym[h] != merged]  # two merges side by side: their pair is entered from the left one
        codes = np.concatenate([merged * v.size + sym[nxt].astype(np.int64), sym[h].astype(np.int64) * v.size + merged])
        for new in self._add(v.ranks(codes), np.concatenate([ahead, h])):
            heappush(self.heap, new)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All identifiers end to end, and where those of each pre-token end."""
        alive = self.sym >= 0
        counts = np.concatenate(([0], np.cumsum(alive)))
        return self.sym[alive], counts[self.ends]


def encode_pretokens(tokens: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The identifiers of all pre-tokens end to end, and where those of each end.

    No merge goes from one pre-token to the next, so stretches of ``INDEX_BYTES`` (or of one longer pre-token) have an index each.
    """
    total = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    ids, ends, at, n = [_NO_IDS], [np.empty(0, np.int64)], 0, 0
    while at < len(tokens):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + INDEX_BYTES, side="right")))
        index = PairIndex(tokens[at:to], vocab)
        if len(index.sym):
            index.run()
        own, own_ends = index.ids()
        del index  # before the next one is made
        ids.append(own)
        ends.append(own_ends + n)
        n += len(own)
        at = to
    return np.concatenate(ids), np.concatenate(ends)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at]


class _Pieces:
    """The different pieces of a lot and, for each chunk, the piece at every place."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.number: dict[str, int] = {}
        self.special: dict[int, int] = {}
        self.words: list[pa.Array] = []

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Take texts that fall apart at each space; how many pieces each has. ``numbered`` tells which."""
        cut = pc.split_pattern(texts, " ")
        self.words.append(cut.flatten())
        return pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)

    def numbered(self, firsts: list[np.ndarray]) -> list[np.ndarray]:
        """The numbers of the pieces taken, in chunks as given; ``firsts`` are the places without a space before them."""
        if not self.words:
            return []
        coded = pa.chunked_array(self.words, pa.string()).dictionary_encode().chunks
        self.words = []
        words, number = coded[-1].dictionary.to_pylist(), self.number
        follow = np.fromiter((number.setdefault(" " + w, len(number)) for w in words), np.int32, len(words))
        out = []
        for chunk, first in zip(coded, firsts, strict=True):
            at = chunk.indices.to_numpy()
            own = follow[at]
            lead, back = np.unique(at[first], return_inverse=True)
            own[first] = np.array([number.setdefault(words[i], len(number)) for i in lead.tolist()], np.int32)[back]
            out.append(own)
        return out

    def odd(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts with added tokens, or with more white space after a space."""
        out, counts, number = [], [], self.number
        for text in texts:
            before = len(out)
            for part, special in self.vocab.segments(text):
                if special is not None:
                    n = number.setdefault(f"\0{special}\0", len(number))
                    self.special[n] = special
                    out.append(n)
                    continue
                first, *rest = pieces(part)
                out.append(number.setdefault(first, len(number)))
                out += [number.setdefault(" " + x, len(number)) for x in rest]
            counts.append(len(out) - before)
        return np.array(out, np.int32), np.array(counts, np.int64)

    def encoded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Identifiers of the pieces end to end, where each piece starts, and how many it has."""
        token: dict[str, int] = {}
        parts: list[int] = []
        n_parts: list[int] = []
        added = []
        pretokens = self.vocab.pretokens
        for text, n in self.number.items():
            if n in self.special:
                added.append((n, self.special[n]))
                n_parts.append(0)
            elif text.isalpha() or (text[:1] == " " and text[1:].isalpha()):  # letters only: one pre-token
                parts.append(token.setdefault(text, len(token)))
                n_parts.append(1)
            else:
                own = pretokens(text)
                parts += [token.setdefault(t, len(token)) for t in own]
                n_parts.append(len(own))
        ids, ends = encode_pretokens([t.encode() for t in token], self.vocab)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        which = np.array(parts, np.int64)
        size_of = (ends - starts)[which] if len(which) else np.empty(0, np.int64)
        flat = gathered(ids, starts[which], size_of) if len(which) else ids
        total = np.concatenate(([0], np.cumsum(size_of)))
        last = np.cumsum(np.array(n_parts, np.int64))
        begin = total[last - np.array(n_parts, np.int64)] if len(n_parts) else last
        sizes = total[last] - begin if len(n_parts) else last
        for n, i in added:
            begin[n], sizes[n] = len(flat), 1
            flat = np.append(flat, np.int32(i))
        return flat, begin, sizes


class Encoder:
    """Identifiers of texts under one vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)

    def lot(self, batches: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """The batches, perhaps in other parts, with all identifiers and how many each row has.

        Each different pre-token of the batches is encoded once.
        """
        found, odd_ones, plain_ones = _Pieces(self.vocab), [], []
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            odd = pc.match_substring_regex(texts, _DOUBLE_SPACE)
            for special in self.vocab.special:
                odd = pc.or_(odd, pc.match_substring(texts, special))
            if pc.any(odd).as_py():
                odd_ones.append((batch.filter(odd), found.odd(texts.filter(odd).to_pylist())))
                plain = pc.invert(odd)
                batch, texts = batch.filter(plain), texts.filter(plain)
            if batch.num_rows:
                plain_ones.append((batch, found.plain(texts)))
        numbers = found.numbered([np.cumsum(counts) - counts for _, counts in plain_ones])
        todo = odd_ones + [(batch, (n, counts)) for (batch, counts), n in zip(plain_ones, numbers, strict=True)]
        flat, begin, sizes = found.encoded()
        del found
        for batch, (numbers, counts) in todo:
            per_piece = sizes[numbers]
            total = np.concatenate(([0], np.cumsum(per_piece)))
            last = np.cumsum(counts)
            yield batch, gathered(flat, begin[numbers], per_piece), total[last] - total[last - counts]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The identifiers of each text as little-endian unsigned 32-bit integers, in the order of the texts."""
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["place", "text"])
        out = [b""] * len(texts)
        for part, ids, counts in self.lot([batch]):
            ends = np.cumsum(counts)
            for i, a, b in zip(part.column("place").to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                out[i] = ids[a:b].astype("<u4").tobytes()
        return out


class Decoder:
    """Texts of identifiers under one vocabulary."""

    def __init__(self, path: str) -> None:
        bytes_of = vocabulary(path).bytes_of
        table = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.sizes = np.fromiter(map(len, table), np.int32, len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of rows that have ``counts`` of the identifiers each; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.sizes[ids]
        total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        ends = total[np.cumsum(counts)]
        raw = _binary(gathered(self.bytes, self.starts[ids], sizes), ends)
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of the data's bytes, each up to its end."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    large = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])
    return large.cast(pa.binary())


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    lot, size = [], 0
    for batch in rebatched(batches, "text", CHUNK_BYTES):
        own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if lot and size + own > LOT_BYTES:
            yield lot
            lot, size = [], 0
            give_back()
        lot.append(batch)
        size += own
    if lot:
        yield lot


def _coded(docs: DataFrame, vocab_path: str, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab_path)
        decoder = Decoder(vocab_path) if with_text else None
        for lot in _lots(batches):
            for batch, ids, counts in encoder.lot(lot):
                columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), _binary(ids.astype("<u4"), 4 * np.cumsum(counts))]
                if decoder:
                    columns.append(decoder(ids, counts))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids", *(["text"] if with_text else [])]
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary" + (", text string" if with_text else ""))


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of each row.

    Strings of added tokens inside a text become those tokens. Null and empty texts have no tokens.
    Repeated rows are encoded one by one; an empty table gives no rows; other columns are not read.
    """
    return _coded(docs, vocab_path, id_col, text_col, with_text=False)


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode``, and behind it the ``text`` that ``decode`` makes of the identifiers, in one worker."""
    return _coded(docs, vocab_path, id_col, text_col, with_text=True)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the decoded ``text`` of each row of identifiers.

    Added tokens are kept; bytes that are no UTF-8 become U+FFFD. Null identifiers give an empty text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocab_path)
        for batch in rebatched(batches, "ids", CHUNK_BYTES):
            rows = [x or b"" for x in batch.column("ids").to_pylist()]
            counts = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("ids"), decoder(ids, counts)], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, text string")
