"""Variant spellings of names (problem 4).

Names become reduced forms; distinct forms get idf-weighted vectors of character 3-grams, in which a nickname also holds the
n-grams of the names it stands for; forms meet by words that may stand for each other (:mod:`laid`); of the pairs whose tokens
can be laid on each other (an exact check: two people of one rare surname have a high cosine too) those with a cosine of at
least ``cosine`` stay; average-linkage clustering over the cosines groups the units (an id, or spellings without id that share a
form) whose mean is high enough.

``top`` keeps the best partners of each form only; by default it is unbounded and no partner is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .graph import components
from .laid import candidates
from .names import FULL, MOST_SLIPS, agree, reduced, shape

GRAM, COSINE, LINK, LARGE, NICK_WEIGHT = 3, 0.3, 0.15, 500, 0.5
SHAPE = ["heads", "letters_0", "letters_1", "core_0", "core_1", "size", "core_size", "tokens", "loose"]
SHAPE_TYPES = "heads bigint, letters_0 bigint, letters_1 bigint, core_0 bigint, core_1 bigint, size int, core_size int, tokens int, loose boolean"


def _reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(0)]
        for k in (1, 2):
            parts, form = reduced(b.column(k))
            text = form.to_pylist()
            cols.append(pa.array([None if p is None else " ".join(p[0]) or t.strip() or None for p, t in zip(parts, text, strict=True)], pa.string()))
            cols.append(pa.array([None if p is None else p[1] for p in parts], pa.string()))
        yield pa.RecordBatch.from_arrays([*cols, b.column(3), b.column(4)], ["key", "form", "qual", "canon", "canon_qual", "mbid", "country"])


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): a number of its own for each different value; written, so that it stays."""
    return materialise(rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, F.monotonically_increasing_id()), name)


def name_rows(df: DataFrame, key: str, name: str, canonical: str, ident: str, country: str) -> DataFrame:
    """(key, form, qual, canon, canon_qual, mbid, country, unit) of each row with a name; the unit is a number for the id, where
    present, else for everything that could tell spellings apart."""
    tidy = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    raw = df.select(F.col(key).cast("string"), F.col(name).cast("string"), F.col(canonical).cast("string"), tidy(ident), tidy(country)).toDF("k", "n", "c", "m", "y")
    rows = raw.mapInArrow(_reduce_rows, "key string, form string, qual string, canon string, canon_qual string, mbid string, country string")
    what = F.coalesce(F.concat(F.lit("\x1e"), "mbid"), F.concat_ws("\x1f", F.lit(""), "form", "qual", F.coalesce("canon", F.lit("\x1e"))))
    rows = rows.where("form is not null").withColumn("qual", F.coalesce(F.nullif("qual", F.lit("")), "canon_qual", F.lit(""))).withColumn("what", what)
    rows = materialise(rows, "reduced")
    return rows.join(numbered(rows, "what", "unit"), "what").drop("what")


def _weights(form: str, gram: int) -> Counter:
    """n-grams of a form with how often they stand in it; of a nickname also those of its full names, at NICK_WEIGHT."""
    found: Counter = Counter()
    for w in form.split(" "):
        for word, much in [(w, 1.0)] + [(x, NICK_WEIGHT) for x in sorted(FULL.get(w, ()))]:
            p = "^" + word
            for k in range(max(1, len(p) - gram + 1)):
                found[p[k : k + gram]] += much
    return found


def _grams(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, grams, counts, shapes = [], [], [], []
            for i, form in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = _weights(form, gram)
                ids += [i] * len(found)
                grams += found.keys()
                counts += found.values()
                shapes += [shape(form)] * len(found)
                if len(ids) > 100_000:
                    yield _gram_batch(ids, grams, counts, shapes)
                    ids, grams, counts, shapes = [], [], [], []
            if ids:
                yield _gram_batch(ids, grams, counts, shapes)

    return run


def _gram_batch(ids: list, grams: list, counts: list, shapes: list) -> pa.RecordBatch:
    looks = [pa.array(c, t) for c, t in zip(zip(*shapes, strict=True), (*[pa.int64()] * 5, *[pa.int32()] * 3, pa.bool_()), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(grams, pa.string()), pa.array(counts, pa.float64()), *looks], ["fid", "gram", "tf", *SHAPE])


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, *looks, parts in zip(b.fid, *[b[c] for c in SHAPE], b.parts, strict=True):
            parts = sorted((x["df"], x["gram"], x["w"]) for x in parts)
            w = np.array([p[2] for p in parts])
            w /= math.sqrt(float((w * w).sum())) or 1.0
            out.append((i, *looks, [p[1] for p in parts], w.tolist(), np.sqrt(np.cumsum((w * w)[::-1])[::-1]).tolist()))
        yield pd.DataFrame(out, columns=["fid", *SHAPE, "grams", "weights", "length"])


def vectors(forms: DataFrame, gram: int = GRAM) -> DataFrame:
    """(fid, form, shape..., grams, weights, length) of forms (fid, form): unit vectors, rarest n-gram first, weights by the
    square root of the idf, so that a slip's rare n-grams don't outweigh the rest; ``length`` is that of the vector from each n-gram on."""
    total = forms.count()
    grams = materialise(forms.select("fid", "form").mapInArrow(_grams(gram), f"fid bigint, gram string, tf double, {SHAPE_TYPES}"), "grams")
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    part = F.struct("df", "gram", (F.col("tf") * F.sqrt(F.log(1 + F.lit(float(total)) / F.col("df")))).alias("w"))
    by_form = grams.join(df, "gram").groupBy("fid").agg(F.collect_list(part).alias("parts"), *[F.first(c).alias(c) for c in SHAPE])
    vec = by_form.mapInPandas(_units, f"fid bigint, {SHAPE_TYPES}, grams array<string>, weights array<double>, length array<double>")
    return materialise(vec.join(forms, "fid"), "vectors")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [k for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) if agree(tuple(x.split(" ")), tuple(y.split(" "))) < 9]
        yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["fa", "fb"])


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sims = []
        for ga, wa, gb, wb in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True):
            other = dict(zip(gb, wb, strict=True))
            sims.append(sum(w * other.get(g, 0.0) for g, w in zip(ga, wa, strict=True)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64())], ["fa", "fb", "sim"])


def similar_forms(vec: DataFrame, least: float = COSINE, top: int | None = None) -> DataFrame:
    """(fa, fb, sim), fa < fb: forms with a cosine ``sim`` of at least ``least`` whose tokens agree; with ``top`` only those that
    are among the best ``top`` partners of one of them. Forms meet in the words of :func:`laid.candidates`, which loses no pair
    that agrees. Pairs whose shapes differ too much cannot agree and leave the join at once; the cosine itself is taken last,
    for the pairs that agree."""
    looks = vec.select("fid", *SHAPE)
    a, b = (d.join(looks.hint("merge"), "fid").select("word", "initial", *[F.col(c).alias(f"{c}_{s}") for c in ("fid", *SHAPE)]) for d, s in zip(candidates(vec.select("fid", "form")), "ab", strict=True))
    half = lambda k, x, y: F.bit_count(F.col(f"core_{k}_{x}").bitwiseAND(F.bitwise_not(f"letters_{k}_{y}")))
    more = lambda x, y: half(0, x, y) + half(1, x, y)
    within = lambda x, y: (more(x, y) <= MOST_SLIPS) & (F.col(f"core_size_{x}") <= F.col(f"size_{y}") + MOST_SLIPS)
    close = within("a", "b") & within("b", "a") & (F.abs(F.col("size_a") - F.col("size_b")) <= MOST_SLIPS)
    alike = close | F.col("loose_a") & within("a", "b") | F.col("loose_b") & within("b", "a")
    alike = alike & (F.abs(F.col("tokens_a") - F.col("tokens_b")) <= 1) & (F.bit_count(F.col("heads_a").bitwiseXOR(F.col("heads_b"))) <= 3)
    met = a.hint("merge").join(b, ["word", "initial"]).where((F.col("fid_a") != F.col("fid_b")) & alike)
    pairs = met.select(F.least("fid_a", "fid_b").alias("fa"), F.greatest("fid_a", "fid_b").alias("fb")).distinct()
    side = lambda cols, s: vec.select(F.col("fid").alias(f"f{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    named = pairs.join(side(["form"], "a"), "fa").join(side(["form"], "b"), "fb").select("fa", "fb", "form_a", "form_b")
    agreed = materialise(named.mapInArrow(_agreeing, "fa bigint, fb bigint"), "agreed")
    full = agreed.join(side(["grams", "weights"], "a"), "fa").join(side(["grams", "weights"], "b"), "fb")
    found = full.select("fa", "fb", "grams_a", "weights_a", "grams_b", "weights_b").mapInArrow(_cosines, "fa bigint, fb bigint, sim double").where(F.col("sim") >= least - 1e-9)
    if top is None:
        return found
    found = materialise(found, "similar")
    either = found.unionByName(found.select(F.col("fb").alias("fa"), F.col("fa").alias("fb"), "sim"))
    best = either.withColumn("rank", F.row_number().over(Window.partitionBy("fa").orderBy(F.desc("sim"), "fb"))).where(F.col("rank") <= top)
    return best.select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb"), "sim").distinct()


def _clash(*columns: str):
    """Whether one of the columns is known on both sides and differs."""
    c = F.lit(False)
    for x in columns:
        c = c | F.coalesce(F.col(f"{x}_a") != F.col(f"{x}_b"), F.lit(False))
    return c


ATTRS = ("mbid", "country", "qual")


def joined(rows: DataFrame) -> DataFrame:
    """Rows with one unit for the units without id that share a form, a qualifier and a country, known or not: they cannot clash
    and are spellings of one, as those of an id are. In the linkage their number would count against them."""
    free = rows.where("mbid is null").groupBy("unit").agg(F.max("country").alias("country"), F.max("qual").alias("qual"))
    named = rows.where("mbid is null").select("unit", F.explode(F.array("form", "canon")).alias("form")).where("form is not null")
    key = ["form", "qual", "country"]
    at = named.join(free, "unit").select("unit", "form", "qual", F.coalesce("country", F.lit("")).alias("country")).distinct()
    hub = at.groupBy(*key).agg(F.min("unit").alias("a"), F.max("unit").alias("z")).where("a < z").select(*key, "a")
    ties = materialise(at.join(hub, key).where("a <> unit").select("a", F.col("unit").alias("b")).distinct(), "ties")
    if ties.isEmpty():
        return rows
    into = components(ties).withColumnRenamed("v", "unit")
    return materialise(rows.join(into, "unit", "left").withColumn("unit", F.coalesce("component", "unit")).select(*rows.columns), "names")


def unit_edges(rows: DataFrame, least: float = COSINE, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(units with attributes, edges (a, b, sim) between units that may mean the same)."""
    units = materialise(
        rows.groupBy("unit").agg(F.max("mbid").alias("mbid"), F.max("country").alias("country"), F.max(F.nullif("qual", F.lit(""))).alias("qual")), "units"
    )
    named = rows.select("unit", F.col("form").alias("form")).unionByName(rows.select("unit", F.col("canon").alias("form")))
    named = named.where("form is not null").distinct()
    forms = numbered(named, "form", "fid")
    ids = materialise(named.join(forms, "form").select("fid", "unit"), "forms")
    sims = similar_forms(vectors(forms), least, top)
    apart = sims.join(ids.toDF("fa", "a"), "fa").join(ids.toDF("fb", "b"), "fb").select("a", "b", "sim")
    # units that share a form: after ``joined`` those without an id are one for each qualifier and country; units with different ids stay apart anyway
    free = ids.join(units.where("mbid is null").select("unit"), "unit").select("fid", F.col("unit").alias("a"))
    same = free.join(ids.toDF("fid", "b"), "fid").select("a", "b", F.lit(1.0).alias("sim"))
    edges = apart.unionByName(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    sides = [units.select(F.col("unit").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ATTRS]) for s in "ab"]
    edges = edges.join(sides[0], "a").join(sides[1], "b").where(~_clash(*ATTRS))
    return units, materialise(edges, "links")


def average_linkage(n: int, pairs: list[tuple[int, int, float]], least: float, attrs: list[tuple]) -> list[int]:
    """Cluster index of each of n items: the pair of clusters with the highest mean similarity merges while it reaches
    ``least``; a pair without an entry counts as 0. Clusters with two different known attributes never merge.

    A mean over two merged clusters is never above the higher of both means, so each row keeps its best partner and looks for
    another only when that partner merges: about n steps over rows of n numbers.
    """
    sums = np.zeros((n, n))
    if pairs:
        i, j, s = (np.array(c) for c in zip(*pairs, strict=True))
        sums[i, j] = sums[j, i] = s
    size, of, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    codes: dict = {None: -1}
    known = np.array([[codes.setdefault((k, v) if v is not None else None, len(codes)) for k, v in enumerate(x)] for x in attrs], np.int64).reshape(n, -1)
    best, partner = np.zeros(n), np.zeros(n, np.int64)

    def look(i: int) -> None:
        fits = alive & ((known == known[i]) | (known < 0) | (known[i] < 0)).all(axis=1)
        fits[i] = False
        mean = np.where(fits, sums[i] / (size * size[i]), 0.0)
        partner[i] = mean.argmax()
        best[i] = mean[partner[i]]

    for i in range(n):
        look(i)
    while n:
        i = int(best.argmax())
        if best[i] <= 0 or best[i] < least:
            break
        i, j = sorted((i, int(partner[i])))
        sums[i] += sums[j]
        sums[:, i] = sums[i]
        size[i] += size[j]
        known[i] = np.where(known[i] < 0, known[j], known[i])
        alive[j], best[j] = False, 0.0
        of[of == j] = i
        look(i)
        for k in np.flatnonzero(alive & ((partner == i) | (partner == j)) & (np.arange(n) != i)):
            look(int(k))
    return of.tolist()


def _link_components(least: float):
    """Clusters of whole components; rows arrive sorted by component, and a component is never cut."""

    def clusters(rows: list[tuple]) -> list[tuple[int, int]]:
        known = {}
        for r in rows:
            known[r[1]], known[r[2]] = r[4:7], r[7:10]
        items = sorted(known)
        at = {u: i for i, u in enumerate(items)}
        of = average_linkage(len(items), [(at[r[1]], at[r[2]], r[3]) for r in rows], least, [known[u] for u in items])
        return [(u, items[c]) for u, c in zip(items, of, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple[int, int]] = []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and held[0][0] != r[0]:
                    done += clusters(held)
                    held = []
                held.append(r)
            if len(done) > 10_000:
                yield _pairs(done)
                done = []
        if held:
            done += clusters(held)
        if done:
            yield _pairs(done)

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["unit", "cluster"])


def linkage_rounds(units: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(unit, cluster): the same clustering for components of any size. In each round every cluster whose best partner has
    it as its best partner merges with it; for average linkage that gives what merging one pair at a time gives."""
    state = materialise(units.select("unit", F.col("unit").alias("cluster"), *ATTRS), "state")
    links = edges.select("a", "b", "sim")
    while True:
        nodes = state.groupBy("cluster").agg(F.count("*").alias("size"), *[F.max(c).alias(c) for c in ATTRS])
        sides = [nodes.select(F.col("cluster").alias(s), F.col("size").alias(f"size_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ATTRS]) for s in "ab"]
        scored = links.join(sides[0], "a").join(sides[1], "b").where(~_clash(*ATTRS))
        scored = scored.withColumn("mean", F.col("sim") / (F.col("size_a") * F.col("size_b"))).where(F.col("mean") >= least).select("a", "b", "mean")
        either = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "mean"))
        rank = F.struct("mean", -F.least("a", "b"), -F.greatest("a", "b"))
        best = materialise(either.groupBy("a").agg(F.max_by("b", rank).alias("b")), "best")
        merge = best.alias("x").join(best.alias("y"), F.expr("x.a = y.b and x.b = y.a and x.a < x.b")).select(F.col("x.b").alias("cluster"), F.col("x.a").alias("into"))
        merge = materialise(merge, "merge")
        if merge.isEmpty():
            return state.select("unit", "cluster")
        state = materialise(state.join(merge, "cluster", "left").select("unit", F.coalesce("into", "cluster").alias("cluster"), *ATTRS), "state")
        moved = links
        for s in "ab":
            moved = moved.join(merge.toDF(s, "into"), s, "left").withColumn(s, F.coalesce("into", s)).drop("into")
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
        links = materialise(moved.groupBy("a", "b").agg(F.sum("sim").alias("sim")), "links")


def link_names(
    df: DataFrame, key: str = "artist_key", name: str = "source_artist_name", canonical: str = "canonical_name", ident: str = "musicbrainz_artist_id",
    country: str = "country", cosine: float = COSINE, link: float = LINK, large: int = LARGE, top: int | None = None,
) -> DataFrame:
    """(key, cluster): rows with the same cluster mean the same.

    An equal ``ident`` joins, a different one keeps apart; so do different countries or qualifiers where both are known.
    Rows without a name are left out; a name without letters or digits is compared as it stands; repeated rows share their
    cluster; an empty table gives an empty table; other columns are ignored. Components of more than ``large`` units are
    clustered by :func:`linkage_rounds`, smaller ones in one task each, with the same result.
    """
    rows = joined(materialise(name_rows(df, key, name, canonical, ident, country), "names"))
    units, edges = unit_edges(rows, cosine, top)
    comp = materialise(components(edges), "components")
    # components is keyed by unit; its size tells which way it goes
    sizes = comp.groupBy("component").agg(F.count("*").alias("units"))
    comp = comp.join(sizes, "component")
    tagged = materialise(edges.join(comp.withColumnRenamed("v", "a"), "a"), "tagged")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = tagged.where(F.col("units") <= large).select("component", "a", "b", "sim", *[f"{c}_{s}" for s in "ab" for c in ATTRS])
    small = ranked.repartition(parts, "component").sortWithinPartitions("component").mapInArrow(_link_components(link), "unit bigint, cluster bigint")
    big = tagged.where(F.col("units") > large)
    clusters = small
    if not big.isEmpty():
        of_big = comp.where(F.col("units") > large).select(F.col("v").alias("unit"))
        clusters = clusters.unionByName(linkage_rounds(units.join(of_big, "unit"), big, link))
    return rows.join(clusters, "unit", "left").select("key", F.coalesce("cluster", "unit").alias("cluster"))


def same_pairs(clusters: DataFrame) -> DataFrame:
    """(artist_key_a, artist_key_b), a < b: every pair of keys in one cluster."""
    keys = clusters.distinct()
    return keys.toDF("artist_key_a", "cluster").join(keys.toDF("artist_key_b", "cluster"), "cluster").where("artist_key_a < artist_key_b").select("artist_key_a", "artist_key_b")
