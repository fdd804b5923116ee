import random
from collections import Counter
from itertools import combinations

import pytest
from cadenza.llm.cooccur import lifted, pair_counts
from pyspark.sql import functions as F


def brute(rows, least):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None and i.strip():
            baskets.setdefault(b, set()).add(i)
    one, two = Counter(), Counter()
    for s in baskets.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    return {(a, b, one[a], one[b], n, len(baskets)) for (a, b), n in two.items() if n >= least}


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "item string, n string")  # clashing names on purpose
    return {tuple(r) for r in pair_counts(df, F.col("item"), F.col("n"), **how).collect()}


@pytest.mark.parametrize(("least", "share"), [(1, 0.05), (3, 0.2), (5, 2.0), (2, 0.0)])
def test_random(spark, least, share):
    rng = random.Random(least)
    items = [f"i{k}" for k in range(30)] + ["é", "Z", " ", "", None, "　"]
    rows = [(rng.choice([None, *map(str, range(80))]), items[min(int(rng.expovariate(0.12)), 35)]) for _ in range(1500)]
    rows += [("big", f"i{k}") for k in range(30)] + [("big", f"only{k}") for k in range(200)] + rows[:50]
    assert run(spark, rows, least=least, heavy_share=share) == brute(rows, least)


def test_large_baskets_of_rare_items(spark):
    """Several baskets with thousands of items that stand in few others: most items make no pairs there."""
    rng = random.Random(2)
    rows = [(f"b{k}", f"i{i}") for k in range(3) for i in rng.sample(range(3000), 1200)] + [(f"s{i}", f"i{j}") for i in range(400) for j in rng.sample(range(3000), 3)]
    rows += [(f"t{k}", f"i{i}") for k in range(4) for i in (5, 6, 7)]
    assert run(spark, rows, least=4) == brute(rows, 4)


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr("cadenza.llm.cooccur.PROBES", 100)
    rng = random.Random(9)
    rows = [(str(rng.randint(0, 60)), f"i{min(int(rng.expovariate(0.1)), 40)}") for _ in range(1500)]
    assert run(spark, rows, least=2, heavy_share=0.3) == brute(rows, 2)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "x")]) == set()


def test_lift(spark):
    df = spark.createDataFrame([("a", "b", 4 * 10**9, 4 * 10**9, 3 * 10**9, 16 * 10**9), ("a", "c", 5, 5, 5, 10)], "a string, b string, n_a bigint, n_b bigint, n_ab bigint, n_baskets bigint")
    assert [r.b for r in lifted(df, 3).collect()] == ["b"]
