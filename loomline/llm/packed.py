"""Packed exchange of (owner, 64-bit value) pairs, for corpora with a pair for each word.

A row holds the pairs of one group from one chunk: owners run-length coded and compressed, values as
fixed-width bytes. What belongs together must be in one row, as a second value behind the first: the
rows of a group come in any order. Spark shuffles and sorts a row for each chunk and group instead of one for each
pair; the work on the pairs is numpy in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

#: kind: what the pairs mean to the receiver.
SCHEMA = "grp int, kind int, n bigint, owners binary, vals binary"
_NAMES = ["grp", "kind", "n", "owners", "vals"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _owners(ids: np.ndarray) -> bytes:
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    runs = np.diff(np.append(starts, len(ids)))
    steps = np.diff(ids[starts], prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(len(starts).to_bytes(8, "little") + steps.astype("<i8").tobytes() + runs.astype("<u4").tobytes())


def _ids(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ids = np.cumsum(np.frombuffer(raw, "<i8", n, 8))
    return np.repeat(ids, np.frombuffer(raw, "<u4", n, 8 + 8 * n))


def _low_bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values(data: memoryview, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view(np.uint64).ravel()


def pack(groups: np.ndarray, owners: np.ndarray, values: np.ndarray, kind: int, width: int = 8, second: np.ndarray | None = None, second_width: int = 4) -> pa.RecordBatch:
    """Rows for the pairs: one for each group. Of a value the ``width`` lowest bytes are kept, of a second one ``second_width``."""
    if not len(groups):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)
    if groups.max() < 1 << 16:
        groups = groups.astype(np.uint16)  # sorted by radix
    order = np.argsort(groups, kind="stable")
    groups, owners, values = groups[order], owners[order], values[order]
    second = None if second is None else second[order]
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    rows = []
    for a, b in zip(starts, np.append(starts[1:], len(groups)), strict=True):
        raw = _low_bytes(values[a:b], width) + (b"" if second is None else _low_bytes(second[a:b], second_width))
        rows.append((int(groups[a]), kind, int(b - a), _owners(owners[a:b]), raw))
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def unpack(table: pa.Table, kind: int, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Owners and values of all rows of a kind."""
    return _unpacked(table, kind, (width,))


def unpack_two(table: pa.Table, kind: int, width: int = 8, second_width: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, values and second values of all rows of a kind."""
    return _unpacked(table, kind, (width, second_width))


def _unpacked(table: pa.Table, kind: int, widths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    out = [[np.empty(0, np.int64)], *([np.empty(0, np.uint64)] for _ in widths)]
    for k, n, o, v in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "owners", "vals")), strict=True):
        if k == kind:
            if len(v) != n * sum(widths):
                raise ValueError(f"{len(v)} bytes for {n} values of {widths} bytes")
            out[0].append(_ids(o))
            at = 0
            for column, width in zip(out[1:], widths, strict=True):
                column.append(_values(memoryview(v)[at : at + n * width], width))
                at += n * width
    return tuple(map(np.concatenate, out))


def empty() -> pa.Table:
    return pa.table({n: pa.array([], t) for n, t in zip(_NAMES, _TYPES, strict=True)})


def classes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal values together (stable), and the class number of each place in it."""
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    first = np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])) if len(values) else np.empty(0, bool)
    return order, np.cumsum(first) - 1
