"""Spellings of names: reduced tokens and the check of one pair (problem 4)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa

from .charform import normal_form

# Letters without a decomposition that people write without their stroke or as two letters.
PLAIN = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t", "ŋ": "n", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d"})
# English given names with the short names in use for them.
NICKNAMES = {
    "alexander": "alex sandy xander al", "elizabeth": "liz beth lizzie betty eliza bess", "katherine": "kate kathy katie kat kathie kitty", "richard": "rick dick rich ricky",
    "michael": "mike mick mickey mikey", "edward": "ed eddie ted ned teddy eddy", "deborah": "deb debbie debby", "anthony": "tony ant", "william": "will bill billy willy liam",
    "robert": "rob bob bobby robbie bert", "josephine": "jo josie", "theodore": "theo ted teddy", "frederick": "fred freddie freddy rick", "victoria": "vicky vicki tori vikki",
    "samantha": "sam sammy", "rebecca": "becky becca", "nicholas": "nick nicky nico", "benjamin": "ben benny benji", "margaret": "maggie meg peggy marge", "thomas": "tom tommy",
    "james": "jim jimmy jamie", "john": "jack johnny", "joseph": "joe joey", "charles": "charlie chuck", "daniel": "dan danny", "matthew": "matt", "christopher": "chris",
    "jennifer": "jen jenny", "patricia": "pat patty trish", "susan": "sue susie", "andrew": "andy drew", "steven": "steve", "stephen": "steve", "david": "dave davy",
    "jonathan": "jon", "gregory": "greg", "kenneth": "ken kenny", "ronald": "ron ronnie", "timothy": "tim timmy", "peter": "pete", "lawrence": "larry", "henry": "harry hank",
    "abigail": "abby", "amanda": "mandy", "barbara": "barb babs", "christina": "tina chris", "dorothy": "dot dottie", "eleanor": "ellie nell", "jacqueline": "jackie", "pamela": "pam",
}
NICK = {n: full for full, names in NICKNAMES.items() for n in names.split()}
FULL: dict[str, set[str]] = {}
for _full, _names in NICKNAMES.items():
    for _n in _names.split():
        FULL.setdefault(_n, set()).add(_full)
MOST_SLIPS = 2
# The rows of the usual keyboard; a slip hits a neighbouring key.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
ARTICLES = ("the", "and")
MOST_COST, BRIEF = 1.1, 4


def plain(text: str) -> str:
    """Lower case without marks, for text already in its consistent form."""
    text = "".join(c for c in unicodedata.normalize("NFD", text.casefold().translate(PLAIN)) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", text)


@lru_cache(50_000)
def reduce_name(text: str) -> tuple[tuple[str, ...], str]:
    """(tokens in sorted order, qualifier) of a name in its consistent form.

    The qualifier is what stands in brackets at the end. "Last, First" and other orders, articles, "&" and "and" and middle
    initials make no difference; a leading initial stays, as one letter. A name of single letters only is one token.
    """
    text = plain(text)
    qualifier = ""
    if m := re.search(r"\s*[(\[]([^()\[\]]*)[)\]]\s*$", text):
        if m.start() > 0:
            text, qualifier = text[: m.start()], re.sub(r"\W+", "", m[1])
    text = re.sub(r"['’`]", "", text)
    text = re.sub(r"(?<=\w) (?:y|und|et|e) (?=\w)", " and ", text)
    raw = re.findall(r"[^\W_]+", text)
    kept = [t for t in raw if t not in ARTICLES] or raw
    if len(kept) > 1 and all(len(t) == 1 for t in kept):
        kept = ["".join(kept)]
    if len(kept) > 2:
        full = [t for t in kept if len(t) > 1]
        kept = full if len(full) >= 2 else kept
    return tuple(sorted(kept)), qualifier


def _neighbours() -> frozenset[tuple[str, str]]:
    at = {c: (row, col + row * 0.5) for row, keys in enumerate(KEYS) for col, c in enumerate(keys)}
    return frozenset((a, b) for a, (r, x) in at.items() for b, (q, y) in at.items() if a != b and abs(r - q) <= 1 and abs(x - y) <= 1)


NEIGHBOURS = _neighbours()


def swap_cost(x: str, y: str) -> int:
    """Slips it takes to write ``y`` for ``x``: 1 for a neighbouring key or letters of no known keyboard, else 2."""
    return 0 if x == y else 2 if x.isascii() and y.isascii() and (x, y) not in NEIGHBOURS else 1


def near(a: str, b: str, most: int) -> int:
    """Slips (insert, delete, replace, swap of neighbours) between two words, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or (_mask(a) ^ _mask(b)).bit_count() > 2 * most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + swap_cost(x, y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most and (before is None or min(row) > most):
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def allowed(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return 0 if n < 3 else 1 if n < 5 else 2


def shortened(a: str, b: str) -> bool:
    """Whether ``a`` may be an abbreviation of ``b``: at most BRIEF letters, two fewer than ``b`` at least, that begin it or stand
    in it in order from its first to its last or last but one."""
    if not 1 < len(a) <= BRIEF or len(b) < len(a) + 2 or a[0] != b[0]:
        return False
    rest = iter(b)
    return b.startswith(a) or a[-1] in b[-2:] and all(c in rest for c in a)


def word_cost(a: str, b: str) -> tuple[float, int, int]:
    """(cost, slips, side) of taking one word for the other: a cost of 0 for the same word, 9 for different words; side is 1 if
    ``a`` is the short form, -1 if ``b`` is."""
    if a == b:
        return 0.0, 0, 0
    side = 1 if len(a) < len(b) else -1
    if len(a) == 1 or len(b) == 1:
        return (0.5, 0, side) if a[0] == b[0] and max(len(a), len(b)) > 1 else (9.0, 0, 0)
    if NICK.get(a) and b in FULL[a]:
        return 0.4, 0, 1
    if NICK.get(b) and a in FULL[b]:
        return 0.4, 0, -1
    if shortened(a, b) or shortened(b, a):
        return 0.4, 0, side
    most = allowed(a, b)
    d = near(a, b, most)
    return (0.3 * d, d, 0) if d <= most else (9.0, 0, 0)


@lru_cache(5_000)
def slipped_article(word: str) -> bool:
    """Whether a word is an article with one slip: another letter that isn't the first, a letter twice or a swap."""
    for w in ARTICLES:
        n = len(w)
        if len(word) == n and (word[0] == w[0] and sum(x != y for x, y in zip(word, w, strict=True)) == 1 or word in {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(n - 1)}):
            return True
        if len(word) == n + 1 and word in {w[: i + 1] + w[i:] for i in range(n)}:
            return True
    return False


def _lay(a: list[str], b: list[str], over: int) -> float:
    """Cost of laying the tokens of ``b`` on those of ``a``, one to one, of which ``over`` may be left as slipped articles."""
    rest_a, rest_b, strong = list(a), [], 0
    for t in b:
        if t in rest_a:
            rest_a.remove(t)
            strong += len(t) > 3
        else:
            rest_b.append(t)
            if len(rest_b) > 3:
                return 9.0
    total, slips, heads, sides = 0.0, 0, 0, set()
    for x in sorted(rest_b, key=len, reverse=True):
        (cost, d, side), at = min((word_cost(x, y), i) for i, y in enumerate(rest_a))
        total += cost
        slips += d
        if total > MOST_COST or slips > MOST_SLIPS:
            return 9.0
        y = rest_a.pop(at)
        strong += min(len(x), len(y)) > 3
        heads += x[:1] != y[:1]
        sides.add(side)
    if not all(slipped_article(x) for x in rest_a):
        return 9.0
    total, slips = total + 0.3 * len(rest_a), slips + len(rest_a)
    return total if strong and heads < 2 and slips <= MOST_SLIPS and total <= MOST_COST and not {1, -1} <= sides else 9.0


def agree(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Cost of laying the tokens of one name on those of the other; 9 if they do not agree.

    At most one token may begin with another letter, there are at most MOST_SLIPS slips in all, short forms stand on one side
    only, and some token must be a full word on both sides. A name of one token more agrees if that token is an article with a slip, or if two of its tokens
    written together are a token of the other.
    """
    if a == b:
        return 0.0
    if len(a) < len(b):
        a, b = b, a
    over = len(a) - len(b)
    if over > 1:
        return 9.0
    best = _lay(list(a), list(b), over)
    if not over:
        return best
    have = Counter(a)
    for t in set(b) - set(a):
        for k in range(1, len(t)):
            if t[:k] in have and t[k:] in have and (t[:k] != t[k:] or have[t[k:]] > 1):
                best = min(best, 0.1 + _lay([*(have - Counter((t[:k], t[k:]))).elements(), t], list(b), 0))
    return best if best <= MOST_COST else 9.0


@lru_cache(100_000)
def _mask(text: str) -> int:
    """126 bits: one for each letter's first, second, third and further occurrences. Collisions only hide differences."""
    mask = 0
    for c, n in Counter(text).items():
        for k in range(min(n, 4)):
            mask |= 1 << ((ord(c) * 4 + k) % 126)
    return mask


HALF = (1 << 63) - 1


def shape(form: str) -> tuple[int, int, int, int, int, int, int, int, bool]:
    """(heads, letters_0, letters_1, core_0, core_1, size, core_size, tokens, loose): bits of the letters that begin tokens, bits of
    all letters and of those outside nicknames and slipped articles in two halves, numbers of these letters, number of tokens,
    and whether a token may be an initial, an abbreviation, a nickname or a slipped article.

    Of forms that agree at most one token begins with another letter and one token more is on one side, so their heads differ
    in three bits at most. On the side of the short forms, or on both if there are none, the core has at most MOST_SLIPS letters
    that the other form lacks and is at most that much longer; without short forms and articles the sizes differ by that much.
    """
    tokens = [t for t in form.split(" ") if t]
    free = [t in NICK or slipped_article(t) for t in tokens]
    core = "".join(t for t, f in zip(tokens, free, strict=True) if not f)
    joined = "".join(tokens)
    heads = 0
    for t in tokens:
        heads |= 1 << (ord(t[0]) % 63)
    halves = [h for m in (_mask(joined), _mask(core)) for h in (m & HALF, m >> 63)]
    return heads, *halves, len(joined), len(core), len(tokens), any(len(t) <= BRIEF for t in tokens) or any(free)


def reduced(col: pa.Array) -> tuple[list[tuple[tuple[str, ...], str] | None], pa.Array]:
    form, _ = normal_form(col)
    return [reduce_name(x) if x is not None else None for x in form.to_pylist()], form
