import random
import time

import pytest
from cadenza.llm import entities
from cadenza.llm.entities import average_linkage, link_names, linkage_rounds, same_pairs
from cadenza.llm.graph import components
from cadenza.llm.names import agree, near, reduce_name

COLUMNS = "artist_key string, source_artist_name string, canonical_name string, musicbrainz_artist_id string, country string, form string, cluster string"


def linked(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS)
    out = {}
    for k, c in link_names(df, **how).collect():
        out.setdefault(c, set()).add(k)
    return sorted(map(sorted, out.values()))


ROWS = [
    ("a1", "Theodore Rušikkëlbir", None, "m1", "ES"), ("a2", "Rusikkelbir, Theodore", None, None, None), ("a3", "T. Rušikkëlbir", None, None, None),
    ("a4", "THEODORE M. RUŠIKKËLBIR​", None, None, "ES"), ("a5", "Ted Rušikkëlbir", None, None, None),
    ("b1", "Vaszu & Selbem", None, None, None), ("b2", "Selbem and Vaszu", None, None, None), ("c1", "Vaszu & Selbem Tribute", None, "m2", None),
    ("d1", "Nelbe Jotpeos (IS)", None, "m3", "IS"), ("d2", "The Nelbe Jotpeos (SE)", None, "m4", "SE"), ("d3", "Nelbe Jotpeos, The (SE)", None, None, None),
    ("e1", "Hunsi Geojem Orch.", None, None, None), ("e2", "Hunsi Geojem Orchestra", None, None, None), ("f1", "Anthony Gehorlunzan", None, "m5", None),
    ("f2", "Richard Gehorlunzan", None, "m6", None), ("g1", "!!!", None, None, None), ("g2", "!!!", None, None, None), ("h1", "", None, None, None), ("h2", None, None, None, None),
    ("i1", "Ranmel Nivel Ensemble", None, "m7", None), ("i2", "completely other", "Ranmel Nivel Ensemble", None, None),
]
WANT = [["a1", "a2", "a3", "a4", "a5"], ["b1", "b2"], ["c1"], ["d1"], ["d2", "d3"], ["e1", "e2"], ["f1"], ["f2"], ["g1", "g2"], ["i1", "i2"]]


def test_link(spark):
    assert linked(spark, ROWS) == WANT


def test_large_components_agree(spark):
    assert linked(spark, ROWS, large=1) == WANT


def test_empty_and_repeated(spark):
    assert linked(spark, []) == []
    assert linked(spark, [ROWS[5], ROWS[5], ROWS[6]]) == [["b1", "b2"]]
    long = ("z", "Very " * 3000 + "Long", None, None, None)
    assert linked(spark, [long, ("y", "Very " * 3000 + "Lonh", None, None, None)])


def test_pairs(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("a", 1)], "key string, cluster bigint")
    assert [tuple(r) for r in same_pairs(df).collect()] == [("a", "b")]


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    n = 14
    pairs = [(i, j, round(rng.uniform(0.3, 1), 4)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.35]
    ids = [rng.choice([None, None, "p", "q"]) for _ in range(n)]
    want = average_linkage(n, pairs, 0.4, [(m, None, None) for m in ids])
    units = spark.createDataFrame([(i, ids[i], None, None) for i in range(n)], "unit bigint, mbid string, country string, qual string")
    edges = spark.createDataFrame(pairs, "a bigint, b bigint, sim double")
    got = dict(map(tuple, linkage_rounds(units, edges, 0.4).collect()))
    part = lambda of: sorted(sorted(i for i in range(n) if of[i] == c) for c in set(of.values()))
    assert part(got) == part(dict(enumerate(want)))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(5, 5), (None, 3)], "a bigint, b bigint")
    got = dict(map(tuple, components(edges).collect()))
    assert {v: c for v, c in got.items()} == {v: 0 if v <= 20 else 21 for v in range(41)}


def test_prefix_join_is_exact(spark):
    """Every pair of forms with the cosine that agrees is found, by brute force over all pairs."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abdegiklmnorstuv") for _ in range(rng.randint(4, 9))) for _ in range(25)]
    forms = set()
    for _ in range(150):
        a, b = sorted((rng.choice(base), rng.choice(base)))
        w = list(a)
        if rng.random() < 0.6:
            k = rng.randrange(len(w))
            w[k] = rng.choice("aeiou")
        forms.add(" ".join(sorted(("".join(w), b))))
    df = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(forms))], "fid bigint, form string")
    vec = entities.vectors(df)
    rows = {r.fid: r for r in vec.collect()}
    want = set()
    for i, x in rows.items():
        for j, y in rows.items():
            if i < j:
                other = dict(zip(y.grams, y.weights, strict=True))
                cos = sum(w * other.get(g, 0) for g, w in zip(x.grams, x.weights, strict=True))
                if cos >= 0.35 and agree(tuple(x.form.split(" ")), tuple(y.form.split(" "))) < 9:
                    want.add((i, j))
    assert want
    assert {(r.fa, r.fb) for r in entities.similar_forms(vec, 0.35).collect()} == want


def test_prefix_join_of_frequent_beside_rare(spark):
    """A rare word ends one form's prefix before the words it shares with another form, whose prefix holds them."""
    rng, least = random.Random(0), 0.35
    word = lambda n: "".join(rng.choice("abdegiklmnorstuv") for _ in range(n))
    often, forms = [word(rng.randint(5, 7)) for _ in range(20)], set()
    for _ in range(200):
        a, b = rng.choice(often), word(rng.randint(5, 9))
        k = rng.randrange(1, len(b) - 2)
        twin = b[:k] + b[k + 1] + b[k] + b[k + 2 :]
        slip = a[:-2] + a[-1] + a[-2]
        forms |= {" ".join(sorted(p)) for p in ((a, b), (a, twin), (slip, twin), (a, b + rng.choice("aeiou")))}
    vec = entities.vectors(spark.createDataFrame(list(enumerate(sorted(forms))), "fid bigint, form string"), 4)
    rows = [(r.fid, tuple(r.form.split(" ")), dict(zip(r.grams, r.weights, strict=True)), {g for g, n in zip(r.grams, r.length, strict=True) if n >= least}) for r in vec.collect()]
    want, tight = set(), 0
    for i, x, u, p in rows:
        for j, y, v, q in rows:
            if i < j and u.keys() & v.keys() and agree(x, y) < 9 and sum(w * v.get(g, 0) for g, w in u.items()) >= least:
                want.add((i, j))
                tight += sum(u[g] * v[g] for g in p & q) < least
    assert tight
    assert {(r.fa, r.fb) for r in entities.similar_forms(vec, least).collect()} == want


def test_pairs_that_agree_are_candidates(spark):
    """By brute force over all pairs: slips in short words, initials, nicknames, short forms, tokens together and apart,
    frequent words beside rare ones. The join finds all pairs that agree and reach the cosine; with nine letters and short
    words that is most of those that agree, in the test tables nearly all."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aeglnorst") for _ in range(n))
    some = ["band", "bob", "robert", "orch", "orchestra", "frederick", "r", "alex", "alexander"] + [word(rng.randint(4, 8)) for _ in range(12)]
    forms = {"nunloikvo r", "nunlokivo r", "luvus zotha", "lvuus zotha", "j r zotha", "ac dc", "acdc", "ann jo smith", "joann smith", "beatles thh", "beatles"}
    for _ in range(150):
        tokens = [rng.choice(some) for _ in range(rng.randint(1, 3))]
        for _ in range(2):
            t = list(rng.choice(tokens))
            k = rng.randrange(len(t))
            t[k : k + 2] = rng.choice([t[k : k + 2][::-1], t[k + 1 : k + 2], [*t[k : k + 2], "e"], ["o", *t[k + 1 : k + 2]]])
            tokens[rng.randrange(len(tokens))] = "".join(t) or "a"
            full = [x for x in tokens if len(x) > 1]
            forms.add(" ".join(sorted(full if len(tokens) > 2 and len(full) > 1 else tokens)))
    named = list(enumerate(sorted(forms)))
    agreeing = {(i, j) for i, x in named for j, y in named if i < j and agree(tuple(x.split(" ")), tuple(y.split(" "))) < 9}
    vec = entities.vectors(spark.createDataFrame(named, "fid bigint, form string"))
    rows = {r.fid: dict(zip(r.grams, r.weights, strict=True)) for r in vec.collect()}
    want = {(i, j) for i, j in agreeing if sum(w * rows[j].get(g, 0) for g, w in rows[i].items()) >= entities.COSINE}
    assert len(want) > 0.8 * len(agreeing)
    assert {(r.fa, r.fb) for r in entities.similar_forms(vec).collect()} == want
    few = {(r.fa, r.fb) for r in entities.similar_forms(vec, top=1).collect()}
    assert few < want and {i for p in few for i in p} == {i for p in want for i in p}


def test_written_together_and_apart(spark):
    rows = [(f"{x}{i}", n, None, None, None) for x, names in {
        "r": ("R.E.M.", "REM"), "n": ("N.W.A", "NWA"), "a": ("AC/DC", "ACDC"), "j": ("Jay-Z", "JayZ"), "s": ("Jo Ann Smith", "Joann Smith", "Smith, Jo-Ann"),
        "t": ("Thh Beatles", "The Beatles", "Beatles, The"), "o": ("Lomri Orch.", "Orchestra Lomri", "Lomri Orchsetra"), "b": ("Ted Vornak", "Theodore Vornak"),
    }.items() for i, n in enumerate(names)]
    assert linked(spark, rows) == [["a0", "a1"], ["b0", "b1"], ["j0", "j1"], ["n0", "n1"], ["o0", "o1", "o2"], ["r0", "r1"], ["s0", "s1", "s2"], ["t0", "t1", "t2"]]


def test_large_dense_component_is_quick():
    rng = random.Random(1)
    n = 2000
    pairs = [(i, j, rng.uniform(0.3, 1)) for i in range(n) for j in range(i + 1, n)]
    start = time.perf_counter()
    of = average_linkage(n, pairs, 0.2, [(None, None, None)] * n)
    assert set(of) == {0} and time.perf_counter() - start < 60


def plain_linkage(n, pairs, least, ids):
    """Average linkage by looking at all pairs of clusters for each merge."""
    sim = {frozenset(p[:2]): p[2] for p in pairs}
    groups = [[i] for i in range(n)]
    id_of = lambda g: {ids[i] for i in g} - {None}
    while True:
        best = (0, None)
        for x in groups:
            for y in groups:
                if x[0] < y[0] and len(id_of(x) | id_of(y)) < 2:
                    mean = sum(sim.get(frozenset((i, j)), 0) for i in x for j in y) / (len(x) * len(y))
                    best = max(best, (mean, (x, y)), key=lambda b: b[0])
        if best[0] < least or not best[1]:
            return sorted(map(sorted, groups))
        x, y = best[1]
        groups = [g for g in groups if g is not x and g is not y] + [sorted(x + y)]


@pytest.mark.parametrize("seed", range(5))
def test_linkage_against_brute_force(seed):
    rng = random.Random(seed)
    n = 18
    pairs = [(i, j, rng.uniform(0.1, 1)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
    ids = [rng.choice([None, None, "p", "q"]) for _ in range(n)]
    of = average_linkage(n, pairs, 0.3, [(m, None, None) for m in ids])
    assert sorted(sorted(i for i in range(n) if of[i] == c) for c in set(of)) == plain_linkage(n, pairs, 0.3, ids)


def test_slips_beside_frequent_words_link(spark):
    rows = [("a1", "Nunloikvo R.", None, None, None), ("a2", "Nunlokivo R.", None, None, None)]
    rows += [(f"o{i}", f"Nunl{x}ko {y}", None, None, None) for i, (x, y) in enumerate((x, y) for x in "aeiou" for y in ("Kibbert", "Vazzum", "Doltre"))]
    assert ["a1", "a2"] in linked(spark, rows)


def test_units_that_share_a_form(spark):
    names = ["Vorn Alpima", "Kestrel Moob", "Tidjuva", "Hessic Brundal", "Opplan", "Quezim Larrow", "Fennuk", "Dastrob Yilm", "Wuxal", "Jempit Gorsu"]
    rows = [(f"s{i}", n, "Ranmel Nivel Ensemble", None, None) for i, n in enumerate(names)]
    assert linked(spark, rows) == [[f"s{i}" for i in range(10)]]
    rows, want = [], []
    for i, n in enumerate(names):
        rows += [(f"{i}a", f"{n} (IS)", None, None, None), (f"{i}b", f"{n} (SE)", None, f"m{i}", None), (f"{i}c", f"{n} (SE)", None, None, None)]
        want += [[f"{i}a"], [f"{i}b", f"{i}c"]]
    assert linked(spark, rows) == want


def test_words():
    assert near("abcd", "abdc", 2) == 1
    assert near("abc", "xyz", 2) == 3
    assert reduce_name("The Sikfîr Kotres") == reduce_name("Sikfir Kotres, The")
    assert reduce_name("A & B (SE)")[1] == "se"
    assert agree(("bob", "gotfirmaize"), ("gotfirmaize", "robert")) < 9
    assert agree(("j",), ("john",)) == 9
