import random

import pyarrow as pa
from cadenza.llm.laid import candidates, near_rows, short_forms, slips
from cadenza.llm.names import agree, allowed, near, shortened


def _twins(rng, letters, low, high, n):
    for _ in range(n):
        w = [rng.choice(letters) for _ in range(rng.randint(low, high))]
        v = list(w)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(v) + 1)
            v[k : k + 2] = rng.choice([v[k : k + 2][::-1], v[k + 1 : k + 2], [rng.choice(letters), *v[k : k + 2]], [rng.choice(letters), *v[k + 1 : k + 2]]])
        if v and abs(len(v) - len(w)) <= 2:
            yield "".join(w), "".join(v)


def test_words_by_rows_and_their_signatures():
    rng = random.Random(1)
    pairs = [*_twins(rng, "abcsdéж", 1, 9, 5000), *_twins(rng, "abcdefgh", 26, 36, 1000)]
    small = [p for p in pairs if max(map(len, p)) <= 30]
    assert near_rows(*[pa.array(c) for c in zip(*small, strict=True)]).tolist() == [near(x, y, 2) for x, y in small]
    for x, y in pairs:
        if x != y and near(x, y, allowed(x, y)) <= allowed(x, y):
            assert set(slips(x)) & set(slips(y))
        if shortened(x, y):
            assert x in set(short_forms(y))


def test_forms_meet_near_their_number(spark):
    """Forms of the same few syllables and given names share n-grams with nearly all others; those they meet stay few."""
    rng = random.Random(2)
    syllables = ["bar", "kir", "tel", "mon", "vas", "gul", "pej", "zor", "hin", "fud"]
    given = ["amara", "noemi", "lucian", "fenna"]
    forms = sorted({" ".join(sorted((rng.choice(given), "".join(rng.choice(syllables) for _ in range(4))))) for _ in range(1500)} | {"b amara", "amara bark"})
    asks, found = candidates(spark.createDataFrame(list(enumerate(forms)), "fid bigint, form string"))
    met = {(r.a, r.b) for r in asks.withColumnRenamed("fid", "a").join(found.withColumnRenamed("fid", "b"), ["word", "initial"]).where("a <> b").collect()}
    met |= {(b, a) for a, b in met}
    assert len(met) < 20 * len(forms)
    some = rng.sample(range(len(forms)), 150)
    for i in some:
        for j in range(len(forms)):
            if i != j and agree(tuple(forms[i].split(" ")), tuple(forms[j].split(" "))) < 9:
                assert (i, j) in met
