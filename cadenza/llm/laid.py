"""Forms whose tokens may be laid on each other, found by one word each (problem 4).

Forms that agree (:func:`names.agree`) lie on each other token by token, once a slipped article is left out or two tokens are
written together: these are a form's variants. Words that may stand for each other are found first, over the different words
only: slips by what is left of a word without one or two letters, short forms by what a full word can be shortened to. Then
each variant looks for the other forms by the one of its full words that leads to the fewest. Initials stand for too many
words to be looked up; they stand on one side only, so the form that has them asks for a token with that letter beside the
word it is looking for. So the work follows the forms that are near each other, not the pairs that share an n-gram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .codepoints import decode, utf8
from .names import BRIEF, MOST_SLIPS, NEIGHBOURS, NICKNAMES, near, slipped_article, word_cost

LONG, ROWS = 30, 100_000
BESIDE = np.zeros((128, 128), bool)
for _a, _b in NEIGHBOURS:
    BESIDE[ord(_a), ord(_b)] = True


def slips(word: str) -> Iterator[str]:
    """What words at most MOST_SLIPS slips away have in common with ``word`` in at least one case: the word without one letter, or
    two from five letters on. Of words near or above LONG letters fifths, by length and number, as they stand at most so many
    letters to the side: two slips touch four of them at most."""
    n = len(word)
    if 3 <= n <= LONG:
        one = {word[:i] + word[i + 1 :] for i in range(n)}
        yield from {word} | one | ({x[:i] + x[i + 1 :] for x in one for i in range(n - 1)} if n >= 5 else set())
    if n > LONG - MOST_SLIPS:
        for size in range(n - MOST_SLIPS, n + MOST_SLIPS + 1):
            for k in range(5):
                low, high = size * k // 5, size * (k + 1) // 5
                for s in {max(0, low + d) for d in range(-MOST_SLIPS, MOST_SLIPS + 1)}:
                    yield f"{size} {k} {word[s : s + high - low]}"


def short_forms(word: str) -> Iterator[str]:
    """Nicknames of a word and what it can be shortened to, see :func:`names.shortened`, initials apart."""
    yield from NICKNAMES.get(word, "").split()
    n = len(word)
    most = min(BRIEF, n - 2)
    yield from (word[:k] for k in range(2, most + 1))
    for p in (n - 2, n - 1) if most >= 2 else ():
        head, last, inner = word[0], word[p], word[1:p]
        yield head + last
        if most >= 3:
            yield from (head + c + last for c in set(inner))
        if most >= 4:
            first = {c: inner.index(c) for c in set(inner)}
            final = {c: inner.rindex(c) for c in first}
            yield from (head + c + d + last for c in first for d in final if first[c] < final[d])


def _found(fn):
    """(sig, word) of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, words = [], []
        for b in batches:
            for w in b.column(0).to_pylist():
                for s in fn(w):
                    sigs.append(s)
                    words.append(w)
                    if len(sigs) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.string()), pa.array(words, pa.string())], ["sig", "word"])
                        sigs, words = [], []
        if sigs:
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.string()), pa.array(words, pa.string())], ["sig", "word"])

    return run


def _codes(words: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one row each, 0 behind their end; and their lengths."""
    points, offs = decode(*utf8(words))
    size = np.diff(offs)
    out = np.zeros((len(size), width), np.int64)
    at = np.arange(len(points)) - np.repeat(offs[:-1], size)
    out[np.repeat(np.arange(len(size)), size), at] = points
    return out, size


def near_rows(x: pa.Array, y: pa.Array) -> np.ndarray:
    """:func:`names.near` of each pair of words at most MOST_SLIPS apart in length, MOST_SLIPS + 1 for more; all pairs at once,
    over the cells of the table that so few slips can reach."""
    far = MOST_SLIPS + 1
    width = max(pc.max(pc.utf8_length(c)).as_py() for c in (x, y))
    (a, n), (b, m) = _codes(x, width), _codes(y, width)
    found = np.full(len(n), far, np.int8)
    edge = np.full((width + 1, len(n)), far, np.int8)
    before, row = edge, edge.copy()
    row[: far] = np.arange(far)[: width + 1, None]
    a, b = a.T.copy(), b.T.copy()
    for i in range(1, width + 1):
        now = edge.copy()
        if i <= MOST_SLIPS:
            now[0] = i
        for j in range(max(1, i - MOST_SLIPS), min(width, i + MOST_SLIPS) + 1):
            p, q = a[i - 1], b[j - 1]
            plain = (p < 128) & (q < 128)
            swap = np.where(p == q, 0, np.where(plain & ~BESIDE[np.where(plain, p, 0), np.where(plain, q, 0)], 2, 1)).astype(np.int8)
            d = np.minimum(np.minimum(row[j], now[j - 1]) + np.int8(1), row[j - 1] + swap)
            if i > 1 and j > 1:
                d = np.where((p == b[j - 2]) & (a[i - 2] == q), np.minimum(d, before[j - 2] + np.int8(1)), d)
            now[j] = np.minimum(d, far)
        end = np.flatnonzero(n == i)
        found[end] = now[m[end], end]
        before, row = row, now
    return found


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with few enough slips, see :func:`names.allowed`."""
    for b in batches:
        size = np.minimum(*[pc.utf8_length(c).to_numpy() for c in b.columns])
        for few in (size <= LONG, size > LONG):
            t = b.filter(pa.array(few))
            most = np.where(size[few] < 3, 0, np.where(size[few] < 5, 1, 2))
            if len(t):
                d = near_rows(*t.columns) if size[few].max() <= LONG else np.array([near(x, y, MOST_SLIPS) for x, y in zip(*[c.to_pylist() for c in t.columns], strict=True)])
                yield t.filter(pa.array(d <= most))


def _brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [k for k, (x, y) in enumerate(zip(*[c.to_pylist() for c in b.columns], strict=True)) if word_cost(x, y)[0] < 9]
        yield b.take(pa.array(keep, pa.int64()))


def like_words(words: DataFrame) -> DataFrame:
    """(x, y), both ways and each with itself: words of ``words`` (word), all different, that may stand for each other, initials apart."""
    spread = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = spread.mapInArrow(_found(slips), "sig string, word string").select(F.xxhash64("sig").alias("h"), F.col("word").alias("x"))
    pairs = left.hint("merge").join(left.withColumnRenamed("x", "y"), "h").where((F.col("x") < F.col("y")) & (F.abs(F.char_length("x") - F.char_length("y")) <= MOST_SLIPS)).select("x", "y")
    brief = spread.mapInArrow(_found(short_forms), "sig string, word string").join(words.withColumnRenamed("word", "sig"), "sig")
    brief = brief.where("sig <> word").select(F.least("sig", "word").alias("x"), F.greatest("sig", "word").alias("y"))
    pairs = pairs.distinct().mapInArrow(_near, "x string, y string").unionByName(brief.mapInArrow(_brief, "x string, y string"))
    pairs = materialise(pairs.distinct(), "like")
    # sizes of exploded rows are estimated from the files they come from, too low for a broadcast: hence the hints
    return pairs.unionByName(pairs.select("y", "x").toDF("x", "y")).unionByName(words.select(F.col("word").alias("x"), F.col("word").alias("y")))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fid, u, v, word): two tokens of a form and both written together."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.string()] * 3), strict=True)], ["fid", "u", "v", "word"])

    rows: list[tuple] = []
    for b in batches:
        for i, form in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            have = Counter(t for t in form.split(" ") if t)
            for u in have:
                for v in have:
                    if u != v or have[u] > 1:
                        rows.append((i, u, v, u + v))
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
    if rows:
        yield batch(rows)


def _variant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fid, kind, initial, words, beside) of each variant of forms (fid, form, u, v): the form with u and v written together, else
    the form itself and without each slipped article; its words, the first letters beside each, and one of its single letters."""
    for b in batches:
        out: list[tuple] = []
        for i, form, u, v in zip(*[c.to_pylist() for c in b.columns], strict=True):
            have = Counter(t for t in form.split(" ") if t)
            kinds = [have] + [have - Counter([t]) for t in have if slipped_article(t)] if u is None else [have - Counter([u, v]) + Counter([u + v])]
            for k, tokens in enumerate(kinds):
                heads = Counter(t[0] for t in tokens.elements())
                own = [(t, "".join(c for c in heads if heads[c] > (c == t[0]))) for t in tokens if len(t) > 1]
                out.append((i, f"{k} {u} {v}", min((t for t in tokens if len(t) == 1), default=""), [t for t, _ in own], [list(o) for _, o in own]))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["fid", "kind", "initial", "words", "beside"])


def candidates(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of forms (fid, form): what they look for (fid, word, initial) and what they are found by (fid, word, initial). Forms that agree
    meet in at least one word and initial."""
    tokens = forms.select("fid", F.explode(F.array_distinct(F.split("form", " "))).alias("word")).where("word <> ''")
    words = materialise(tokens.groupBy("word").agg(F.count("*").alias("n")), "words")
    apart = forms.mapInArrow(_together, "fid bigint, u string, v string, word string").join(words.select("word"), "word", "left_semi")
    both = forms.select("fid", "form", F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("v"))
    both = both.unionByName(apart.join(forms, "fid").select("fid", "form", "u", "v"))
    made = materialise(both.mapInArrow(_variant, "fid bigint, kind string, initial string, words array<string>, beside array<array<string>>"), "variants")
    like = like_words(words.where(F.char_length("word") > 1).select("word"))
    reach = like.join(words.withColumnRenamed("word", "y"), "y").groupBy(F.col("x").alias("word")).agg(F.sum("n").alias("reach"))
    # what agrees has a full word of more than three letters on both sides
    asks = made.select("fid", "kind", "initial", F.explode("words").alias("word")).where(F.char_length("word") > 3).join(reach, "word")
    asks = asks.groupBy("fid", "kind").agg(F.min_by("word", F.struct("reach", "word")).alias("x"), F.first("initial").alias("initial"))
    asks = asks.join(like.hint("merge"), "x").select("fid", F.col("y").alias("word"), "initial").distinct()
    each = made.select("fid", F.explode(F.arrays_zip("words", "beside")).alias("p")).select("fid", F.col("p.words").alias("word"), F.explode(F.array_append("p.beside", F.lit(""))).alias("initial"))
    return asks, each.distinct()
