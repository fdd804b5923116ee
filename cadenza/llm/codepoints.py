"""Arrow strings as numpy code-point arrays and back, whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, byte offsets of len(col) + 1): the UTF-8 data of a string array; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def decode(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of UTF-8 data."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, heads[offs]


def byte_lengths(points: np.ndarray) -> np.ndarray:
    """UTF-8 length of each code point."""
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def encode(points: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A large_string array from code points and offsets."""
    data = points.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    at = np.concatenate([[0], np.cumsum(byte_lengths(points))])[offs]
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
