"""Titles of tracks: what of a written title tells tracks apart."""

from __future__ import annotations

import re
from functools import lru_cache

from .names import near, plain

# Words of notes that leave a track the same, and words that make it another version.
EDITION = {"remaster", "remastered", "deluxe", "expanded", "explicit", "bonus", "edition", "anniversary", "reissue", "clean", "mono", "stereo"}
EDITION_NOTES = {"album version", "single version", "original version", "original album version", "lp version"}
VERSION = {"live", "acoustic", "instrumental", "remix", "mix", "demo", "edit", "unplugged", "session", "karaoke", "cover", "reprise", "dub", "orchestral", "rehearsal", "take"}
GUEST = re.compile(r"^(?:feat|ft|featuring|with|w)\b\.?\s")
GUEST_TAIL = re.compile(r"\s(?:feat|ft|featuring)\b\.?\s.*$")
COUNTED = {"pt": "pt", "part": "pt", "parts": "pt", "no": "no", "number": "no", "nr": "no", "vol": "vol", "volume": "vol", "chapter": "ch"}
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
SEP = "\x1f"


def _split(text: str) -> tuple[str, list[str]]:
    """(text without its trailing notes, the notes): bracketed groups at the end and parts after " - "."""
    notes: list[str] = []
    while True:
        text = text.rstrip(" .")
        if text and text[-1] in ")]":
            depth = 0
            for i in range(len(text) - 1, -1, -1):
                depth += (text[i] in ")]") - (text[i] in "([")
                if depth == 0:
                    break
            if depth == 0 and text[:i].strip():
                notes.append(text[i + 1 : -1].strip())
                text = text[:i]
                continue
        head, dash, tail = text.rpartition(" - ")
        if dash and head.strip():
            notes.append(tail.strip())
            text = head
            continue
        return text, notes


def _edition(word: str) -> bool:
    return word in EDITION or len(word) > 5 and any(near(word, x, 1) <= 1 for x in EDITION if len(x) > 5)


def _version_of(note: str) -> str:
    """What of a note makes another version; "" for editions and guests."""
    if GUEST.match(note + " "):
        return ""
    words = re.findall(r"[^\W_]+", re.sub(r"['’]", "", note))
    if " ".join(words) in EDITION_NOTES:
        return ""
    rest = [w for w in words if not _edition(w)]
    if len(rest) < len(words):  # a year or "version" beside an edition word says nothing
        rest = [w for w in rest if w in VERSION]
    return " ".join(rest)


@lru_cache(50_000)
def title_key(text: str) -> str:
    """words, version and numbers of a title in its consistent form, joined by a separator."""
    base, notes = _split(plain(text))
    kept = [_version_of(n) for n in reversed(notes)]
    if (m := GUEST_TAIL.search(base)) and m.start() > 0:  # notes behind a guest's name may belong to the name
        base, before = _split(base[: m.start()])
        kept = [_version_of(n) for n in reversed(before)] + [v for v in kept if set(v.split()) & VERSION]
    kept = [v for v in kept if v]
    words, numbers = [], []
    raw = re.findall(r"[^\W\d_]+|\d+", re.sub(r"['’`]", "", base)) or [base.strip()]
    for i, w in enumerate(raw):
        if w.isdigit():
            numbers.append(w.lstrip("0") or "0")
        elif i and raw[i - 1] in COUNTED and w in ROMAN:
            numbers.append(ROMAN[w])
        elif w in COUNTED and i + 1 < len(raw) and (raw[i + 1].isdigit() or raw[i + 1] in ROMAN):
            words.append(COUNTED[w])
        else:
            words.append(w)
    return SEP.join((" ".join(words), " ".join(kept), " ".join(numbers)))


def _slips(a: str, b: str, limit: int) -> bool:
    """Whether two phrases are the same but for slips of typing, word by word."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return near(a.replace(" ", ""), b.replace(" ", ""), 1) <= 1 and min(len(a), len(b)) > 4
    total = 0
    for p, q in zip(x, y, strict=True):
        n = min(len(p), len(q))
        most = 0 if n < 2 else 1 if n < 5 else 2
        d = near(p, q, most)
        if d > most:
            return False
        total += d
    return total <= limit


@lru_cache(50_000)
def same_title(a: str, b: str) -> bool:
    """Whether two keys mean the same title: equal numbers, and words and version equal but for slips of typing."""
    if a == b:
        return True
    wa, va, na = a.split(SEP)
    wb, vb, nb = b.split(SEP)
    return na == nb and bool(va) == bool(vb) and _slips(va, vb, 2) and _slips(wa, wb, 3)
