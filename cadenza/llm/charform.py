"""One form for texts that look alike (problem 6).

Compatibility characters are decomposed, marks put in canonical order and composed again, invisible characters dropped,
every blank becomes U+0020, and letters that are foreign to their word but look like one of its script become that letter.
All of it on code-point arrays: table gathers with expansion offsets, then vector steps; no string call per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import decode, encode, gather, utf8

SIZE = 0x110000
LATIN, CYRILLIC, GREEK, ODD, OTHER = 1, 2, 4, 8, 16

# Letters of other alphabets, and rare Latin ones, with the Latin letter that looks the same.
LOOKS_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Һ": "H", "а": "a", "в": "b", "е": "e",
    "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ԁ": "d", "һ": "h", "ѵ": "v", "ԛ": "q", "ԝ": "w", "ү": "y", "г": "r", "п": "n", "ӏ": "l", "Ӏ": "I", "ԍ": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "ς": "c",
    "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï", "Ά": "Á", "Έ": "É", "Ή": "H", "Ί": "Í", "Ό": "Ó", "Ύ": "Ý", "ά": "á", "έ": "é",
    "ί": "í", "ό": "ó", "ύ": "ú", "Ӓ": "Ä", "ӓ": "ä", "Ӧ": "Ö", "ӧ": "ö", "Ӑ": "Ă", "ӑ": "ă", "ӱ": "ÿ",
    "Ա": "U", "Ս": "U", "Օ": "O", "օ": "o", "ո": "n", "հ": "h", "ս": "u", "ց": "g", "զ": "q", "յ": "j", "ռ": "n",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ɪ": "i", "ʙ": "b", "ᴜ": "u",
}

# Cyrillic and Greek letters that look like a Latin one well enough to be put back from it.
TO_CYRILLIC = {
    "A": "А", "B": "В", "E": "Е", "S": "Ѕ", "I": "І", "J": "Ј", "K": "К", "M": "М", "H": "Н", "O": "О", "P": "Р", "C": "С",
    "T": "Т", "Y": "У", "X": "Х", "a": "а", "e": "е", "s": "ѕ", "i": "і", "j": "ј", "o": "о", "p": "р", "c": "с", "y": "у",
    "x": "х", "h": "һ", "Ë": "Ё", "ë": "ё", "k": "к", "m": "м", "t": "т", "b": "в",
}
TO_GREEK = {
    "A": "Α", "B": "Β", "E": "Ε", "Z": "Ζ", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ",
    "Y": "Υ", "X": "Χ", "a": "α", "i": "ι", "k": "κ", "v": "ν", "o": "ο", "p": "ρ", "u": "υ", "x": "χ", "y": "γ", "c": "ϲ",
}

# Characters without a visible form that are not of the general category Cf.
ALSO_INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
APOSTROPHES = [0x27, 0x2019, 0x2BC]


class Tables:
    """Lookup tables by code point, made from the interpreter's Unicode data."""

    def __init__(self) -> None:
        self.length = np.ones(SIZE, np.uint8)
        self.start = np.zeros(SIZE, np.int32)
        self.ccc = np.zeros(SIZE, np.uint8)
        self.blank = np.zeros(SIZE, bool)
        self.unseen = np.zeros(SIZE, bool)
        self.script = np.zeros(SIZE, np.uint8)
        data: list[int] = [0]  # so that every decomposition starts above 0
        pairs: dict[int, int] = {}
        for c in [*range(0x30000), *range(0xE0000, 0xE1000)]:
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Cs", "Co"):
                continue
            if m := unicodedata.combining(ch):
                self.ccc[c] = m
            if cat == "Cf":
                self.unseen[c] = True
            elif cat[0] == "Z" or cat == "Cc" and ch.isspace():
                self.blank[c] = True
            elif cat[0] == "L":
                self.script[c] = self._script(c, ch)
            d = unicodedata.decomposition(ch)
            if d or 0xAC00 <= c <= 0xD7A3:
                full = unicodedata.normalize("NFKD", ch)
                self.length[c], self.start[c] = len(full), len(data)
                data += map(ord, full)
                if d and d[0] != "<" and " " in d:
                    a, b = (int(x, 16) for x in d.split())
                    if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                        pairs[a << 21 | b] = c
        self.data = np.array(data, np.uint32)
        self.unseen[ALSO_INVISIBLE] = True
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.latin = self._map(LOOKS_LATIN)
        self.cyrillic = self._map(TO_CYRILLIC)
        self.greek = self._map(TO_GREEK)
        self.odd = self.script == ODD
        self.inner = (self.script > 0) | (self.ccc > 0)
        self.inner[APOSTROPHES] = True

    @staticmethod
    def _script(c: int, ch: str) -> int:
        if ch in "ɑɡɩʏᴄᴏᴠᴡᴢꜱɪʙᴜ":
            return ODD
        if 0x1100 <= c < 0x1C80 or 0x2E80 <= c < 0xA640 or c >= 0x10000:
            return OTHER
        name = unicodedata.name(ch, "")
        return LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else ODD if name.startswith("ARMENIAN") else OTHER

    @staticmethod
    def _map(pairs: dict[str, str]) -> np.ndarray:
        out = np.zeros(SIZE, np.uint32)
        for a, b in pairs.items():
            out[ord(a)] = ord(b)
        return out

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composite of each pair of code points, or 0."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        key = a << 21 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        out = np.where(self.pair_keys[at] == key, self.pair_values[at], 0)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        out = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, out)
        lvt = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        return np.where(lvt, a + (b - 0x11A7), out).astype(np.uint32)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _keep(points: np.ndarray, offs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[mask], np.concatenate([[0], np.cumsum(mask)])[offs]


def _segments(t: Tables, points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of the starter, or of the row's first character, that each character belongs to."""
    head = t.ccc[points] == 0
    head[offs[:-1][offs[:-1] < len(points)]] = True
    return np.maximum.accumulate(np.where(head, np.arange(len(points)), 0))


def normal_points(points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of texts given as code points with row offsets."""
    t = tables()
    if not len(points):
        return points, offs
    size = t.length[points].astype(np.int64)
    grown = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(points, size)
    many = np.flatnonzero(t.start[points] > 0)
    if len(many):
        out[gather(grown[many], size[many])] = t.data[gather(t.start[points[many]].astype(np.int64), size[many])]
    out, offs = _keep(out, grown[offs], ~t.unseen[out])
    out[t.blank[out]] = 0x20
    if not len(out):
        return out, offs
    seg, ccc = _segments(t, out, offs), t.ccc[out]
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (seg[1:] == seg[:-1])).any():
        out = out[np.lexsort((np.arange(len(out)), ccc, seg))]
    out, offs = _compose(t, out, offs)
    return _fold(t, out, offs), offs


def _compose(t: Tables, out: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    while True:
        out, offs = _compose_marks(t, out, offs)
        out, offs, again = _compose_starters(t, out, offs)
        if not again:
            return out, offs


def _compose_marks(t: Tables, out: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seg, ccc = _segments(t, out, offs), t.ccc[out]
    rank = np.arange(len(out)) - seg
    gone = np.zeros(len(out), bool)
    last = np.zeros(len(out), np.uint8)  # class of the last mark that stayed, by starter
    marks = np.flatnonzero(rank > 0)
    marks = marks[np.argsort(rank[marks], kind="stable")]
    ends = np.flatnonzero(np.diff(rank[marks], append=-1)) + 1
    for i in np.split(marks, ends[:-1]) if len(marks) else ():  # first marks, second marks and so on; each mark is looked at once
        s = seg[i]
        new = t.compose(out[s], out[i])
        take = (new > 0) & (last[s] < ccc[i]) & (t.ccc[out[s]] == 0)
        out[s[take]] = new[take]
        gone[i[take]] = True
        last[s[~take]] = ccc[i[~take]]
    return _keep(out, offs, ~gone)


def _compose_starters(t: Tables, out: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """One step of composing a starter with the starter after it: Hangul, a few Indic vowels."""
    if len(out) < 2:
        return out, offs, False
    row = np.zeros(len(out) + 1, bool)
    row[offs] = True
    new = t.compose(out[:-1], out[1:])
    i = np.flatnonzero((new > 0) & ~row[1:-1] & (t.ccc[out[1:]] == 0))
    if not len(i):
        return out, offs, False
    i = i[np.concatenate([[True], np.diff(i) > 1])]
    out[i] = new[i]
    mask = np.ones(len(out), bool)
    mask[i + 1] = False
    out, offs = _keep(out, offs, mask)
    return out, offs, True


def _fold(t: Tables, out: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Foreign look-alikes inside a word become letters of the word's own script: Latin where every letter has a Latin
    form, else Cyrillic or Greek where every letter has such a form, else as it was."""
    inner = t.inner[out]
    start = inner.copy()
    start[1:] &= ~inner[:-1]
    first = offs[:-1][offs[:-1] < len(out)]
    start[first] = inner[first]
    heads = np.flatnonzero(start)
    if not len(heads):
        return out
    at = np.flatnonzero(inner)
    word = np.cumsum(start)[at] - 1
    begin = np.searchsorted(word, np.arange(len(heads)))
    letters, script = out[at], t.script[out[at]]
    scripts = np.bitwise_or.reduceat(script, begin)
    mixed = (scripts & (scripts - 1)) > 0
    if not mixed.any():
        return out
    m = mixed[word]
    at, word, letters, script = at[m], word[m], letters[m], script[m]
    new = letters.copy()
    n = len(heads)
    done = np.zeros(n, bool)
    for own, to in ((LATIN, t.latin), (CYRILLIC, t.cyrillic), (GREEK, t.greek)):
        via = letters if own == LATIN else np.where(t.odd[letters] | (script & (CYRILLIC | GREEK)) > 0, np.where(script == own, letters, t.latin[letters]), letters)
        form = np.where((script == own) | (script == 0), letters, to[via])
        bad = np.bincount(word, form == 0, n) > 0
        has = np.bincount(word, script == own, n) > 0
        ok = ~bad & has & ~done
        use = ok[word]
        new[use] = form[use]
        done |= ok
    out[at] = new
    return out


def needs_work(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows with a byte outside printable ASCII; all others are in their form already."""
    odd = np.concatenate([[0], np.cumsum((data >= 0x7F) | (data < 0x20))])
    return odd[offs[1:]] > odd[offs[:-1]]


def normal_form(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(normal form, which rows changed) of a string array. Null stays null and counts as unchanged."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    data, offs = utf8(col)
    work = np.flatnonzero(needs_work(data, offs))
    changed = np.zeros(len(col), bool)
    if not len(work):
        return col, changed
    points, at = decode(*utf8(col.take(pa.array(work))))
    new, new_at = normal_points(points.copy(), at)
    same = np.diff(at) == np.diff(new_at)
    size = np.diff(at)[same]
    differ = points[gather(at[:-1][same], size)] != new[gather(new_at[:-1][same], size)]
    total = np.concatenate([[0], np.cumsum(differ)])
    ends = np.cumsum(size)
    same_rows = np.flatnonzero(same)
    moved = np.ones(len(work), bool)
    moved[same_rows] = total[ends] > total[ends - size]
    changed[work] = moved
    if not moved.any():
        return col, changed
    rows = np.flatnonzero(moved)
    size = np.diff(new_at)[rows]
    texts = encode(new[gather(new_at[:-1][rows], size)], np.concatenate([[0], np.cumsum(size)]))
    mask = pa.array(changed)
    return pc.replace_with_mask(col.cast(pa.large_string()), mask, texts), changed


def _found(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for k, name in enumerate(fields):
                _, changed = normal_form(b.column(k + 1))
                if changed.any():
                    hit = ids.filter(pa.array(changed))
                    yield pa.RecordBatch.from_arrays([hit, pa.array([name] * len(hit))], ["row_no", "field_name"])

    return run


def not_in_form(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(row_no, field_name): the values of ``fields`` that differ from their consistent form. One pass, no shuffle.

    Null and empty texts are in form. A repeated row is reported as often as it stands. ``key`` is a bigint column.
    """
    return df.select(F.col(key).cast("bigint"), *fields).mapInArrow(_found(fields), "row_no bigint, field_name string")


def _rewrite(at: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            for k in at:
                cols[k] = normal_form(cols[k])[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[str(i) for i in range(len(cols))])

    return run


def in_form(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with ``fields`` in their consistent form; every other column and row as it was."""
    at = [df.columns.index(f) for f in fields]
    names = df.columns
    plain = df.toDF(*[str(i) for i in range(len(names))])
    return plain.mapInArrow(_rewrite(at), plain.schema).toDF(*names)
