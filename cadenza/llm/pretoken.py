"""Pre-tokens of the public byte-level BPE vocabularies, for a whole batch of texts at once.

The pattern splits contractions, letter runs, digit runs and other runs, each with a leading space if there is one, and
leaves the other white space in runs of its own. Here the borders come from comparing classes of neighbouring characters;
the pre-tokens are then slices of the UTF-8 buffer, and Arrow's dictionary encoding numbers the distinct ones.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .codepoints import byte_lengths, decode

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# The white space of the pattern's \s.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE, TWO_HEAD = "stmd", {"r": "e", "v": "e", "l": "l"}  # 's 't 'm 'd and 're 've 'll


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        cat = unicodedata.category(chr(c))[0]
        if cat == "L":
            table[c] = LETTER
        elif cat == "N":
            table[c] = NUMBER
    table[WHITE] = SPACE
    return table


def borders(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where a pre-token starts, for texts given as code points with offsets."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[offs[:-1][offs[:-1] < n]] = True
    last = np.zeros(n, bool)
    last[:-1] = first[1:]
    last[-1] = True
    white = kind == SPACE
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    # white space before something else leaves its last character out; a plain space goes with what follows
    before = np.zeros(n, bool)
    before[:-1] = white[:-1] & ~white[1:]
    before &= ~last
    blank = points == 0x20
    start = run | before
    glued = np.zeros(n, bool)
    glued[1:] = before[:-1] & blank[:-1]
    start &= ~glued
    # contractions: an apostrophe that starts a pre-token
    quote = np.flatnonzero(start & (points == 0x27) & ~last)
    if len(quote):
        nxt = points[quote + 1]
        inside = ~first[quote + 1]
        one = inside & np.isin(nxt, [ord(c) for c in ONE])
        two = np.zeros(len(quote), bool)
        room = inside & ~last[quote + 1]
        third = points[np.minimum(quote + 2, n - 1)]
        for a, b in TWO_HEAD.items():
            two |= room & (nxt == ord(a)) & (third == ord(b))
        for which, size in ((one, 2), (two, 3)):
            q = quote[which]
            start[q + 1] = False
            if size == 3:
                start[q + 2] = False
            stop = q + size
            start[stop[stop < n]] = True  # a following space-glued or white start is set already
    return start


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all pre-tokens in order as a large_binary array, number of pre-tokens of each text)."""
    points, at = decode(data, offs)
    start = np.flatnonzero(borders(points, at))
    place = np.concatenate([[0], np.cumsum(byte_lengths(points))]) if len(points) != len(data) else None
    cuts = np.concatenate([start, [len(points)]])
    if place is not None:
        cuts = place[cuts]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return words, np.diff(np.searchsorted(start, at))
