"""Encoded lines over Arrow arrays: all texts of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Groups of five bits that a whole number of 63 bits fills at most.
GROUPS = 13


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def encoded(lines: pa.Array, digits: int) -> pa.Array:
    """Polyline texts of lists of struct(lon, lat). A missing coordinate leaves out its point and the next; no list is an empty text."""
    sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = lines.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    first = np.zeros(len(row), bool)
    first[_starts(sizes)[sizes > 0]] = True
    keep, moved = np.ones(len(row), bool), []
    for name in ("lat", "lon"):
        own = pc.struct_field(flat, name).cast(pa.float64())
        known = own.is_valid().to_numpy(zero_copy_only=False)
        x = own.fill_null(0.0).to_numpy(zero_copy_only=False) * float(10**digits)
        if not (np.abs(x) < 2.0**60).all():
            raise ValueError("a coordinate is no number that a line can hold")
        whole = np.trunc(x)
        whole = (whole + np.copysign(np.abs(x - whole) >= 0.5, x)).astype(np.int64)
        keep &= known & (first | np.roll(known, 1))
        moved.append(whole - np.where(first, 0, np.roll(whole, 1)))
    d = np.stack(moved, 1)[keep].ravel()
    v, n = np.where(d < 0, ~(d << 1), d << 1), np.ones(len(d), np.int64)
    for k in range(1, GROUPS):
        more = v >> 5 * k > 0
        if not more.any():
            break
        n += more
    # Five bits a character, low ones first; all of a number but the last have 32 added.
    at, pos = np.repeat(np.arange(len(v)), n), np.arange(n.sum()) - np.repeat(_starts(n), n)
    text = ((v[at] >> 5 * pos & 31) + np.where(pos < n[at] - 1, 32, 0) + 63).astype(np.uint8)
    ends = np.cumsum(np.bincount(np.repeat(row[keep], 2), weights=n, minlength=len(sizes)).astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(text)).cast(pa.string())


def decoded(texts: pa.Array, digits: int) -> pa.Array:
    """Lists of struct(lon, lat) of polyline texts; what a text ends with short of a whole point is left out, and null is null."""
    own = ["" if t is None else t for t in texts.to_pylist()]
    code = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").astype(np.int64) - 63
    row = np.repeat(np.arange(len(own)), [len(t) for t in own])
    ends = np.flatnonzero(code < 32)
    number = np.searchsorted(ends, np.arange(len(code)))
    held = number < len(ends)
    held[held] = row[ends[number[held]]] == row[held]
    code, row, number = code[held], row[held], number[held]
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    pos = np.arange(len(code)) - np.repeat(starts, np.diff(starts, append=len(code)))
    low = code & 31
    if (pos >= GROUPS).any() or (low[pos == GROUPS - 1] >= 8).any():
        raise ValueError("a number of an encoded line has more than 63 bits")
    v = np.add.reduceat(low << 5 * pos, starts) if len(starts) else np.zeros(0, np.int64)
    d, row = np.where(v & 1, ~(v >> 1), v >> 1), row[starts]
    each = np.bincount(row, minlength=len(own))
    d = d[np.arange(len(d)) - _starts(each)[row] < each[row] // 2 * 2].reshape(-1, 2)
    n = each // 2
    sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(d, 0)])
    at = (sums[1:] - np.repeat(sums[_starts(n)], n, axis=0)) / float(10**digits)
    points = pa.StructArray.from_arrays([pa.array(at[:, 1]), pa.array(at[:, 0])], ["lon", "lat"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, points, mask=texts.is_null())
