"""A byte-level BPE vocabulary file: merges, added tokens, and how a text falls into pieces.

The file is the JSON of the public ``tokenizers`` format. Only its tables are used; the merging
itself is in ``bpe_codec`` and ``token_counts``. A piece is a space and what follows up to the next
space before a non-space: the file's pattern never joins characters across such a place, so pieces
can be looked up whole, and the pattern is run once for each different piece.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex

#: Fixed value: the pattern of the byte-level pre-tokenizer.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEFORE_WORD = re.compile(r" (?=\S)")
_DOUBLE_SPACE = re.compile(r" \s")


#: Code points that the ``regex`` module's Unicode 17 calls letters or numbers, and the
#: Unicode 16 of the format's library does not.
_NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_NEWER_CODES = frozenset(c for x in _NEWER.split() for c in range(int(x.split("-")[0], 16), int(x.split("-")[-1], 16) + 1))


def _plain(piece: str) -> str:
    """The piece with a symbol in place of each character that is in ``_NEWER``."""
    return "".join("\ufffd" if ord(c) in _NEWER_CODES else c for c in piece)


@lru_cache(2)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such files: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one file: ``merges[(left, right)] = (rank, merged id)`` and bytes of each id.

    Of each rank ``lefts``, ``rights`` and ``merged``. No merge may stand before one that makes its parts, so a merge
    never opens the way for a lower rank: all places of a rank can be merged at once.
    """

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        ids = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.first = [ids[letters[b]] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.size = max(max(ids.values()) + 1, 1)
        self.lefts, self.rights, self.merged = ([column(a, b) for a, b in pairs] for column in (lambda a, b: ids[a], lambda a, b: ids[b], lambda a, b: ids[a + b]))
        made = {m: rank for rank, m in enumerate(self.merged)}
        if len(made) < len(pairs) or any(max(made.get(a, -1), made.get(b, -1)) > rank for rank, (a, b) in enumerate(zip(self.lefts, self.rights, strict=True))):
            raise ValueError(f"{path}: a merge stands before one that makes its parts, or two make the same token")
        self.rank_of = {a * self.size + b: rank for rank, (a, b) in enumerate(zip(self.lefts, self.rights, strict=True))}
        self.first_ids = np.array(self.first, np.int32)
        codes = np.fromiter(self.rank_of, np.int64, len(pairs))
        order = np.argsort(codes)
        self._codes, self._ranks = np.append(codes[order], np.int64(1) << 62), np.append(order, -1).astype(np.int32)
        self.byte_ranks = self.ranks((self.first_ids[:, None].astype(np.int64) * self.size + self.first_ids[None, :]).ravel()).reshape(256, 256)
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.special: dict[str, int] = {}
        for token in spec.get("added_tokens", []):
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"{token['content']}: only plain added tokens are known")
            self.special[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._tokens = regex.compile(_PATTERN)

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        """The rank of each pair ``left * size + right``; -1 for one that is no merge."""
        at = np.searchsorted(self._codes, codes)
        return np.where(self._codes[at] == codes, self._ranks[at], np.int32(-1))

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text between added tokens, and those tokens with their ids, in order."""
        if not self._special or not self._special.search(text):
            return [(text, None)]
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.special[m[0]])]
            at = m.end()
        return [x for x in [*out, (text[at:], None)] if x[0]]

    def pretokens(self, piece: str) -> list[str]:
        if piece.isascii() or (plain := _plain(piece)) == piece:
            return self._tokens.findall(piece)
        return [piece[m.start() : m.end()] for m in self._tokens.finditer(plain)]


def pieces(text: str) -> list[str]:
    """The text cut before each space that a non-space follows; ``' '.join`` gives it back.

    All but the first piece lost the space before them.
    """
    return _BEFORE_WORD.split(text) if _DOUBLE_SPACE.search(text) else text.split(" ")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
