import random

import pytest
from cadenza.llm.packing import pack, plan


def best_fit(sizes, capacity):
    """One item at a time, longest first, into the fullest container that takes it."""
    spaces = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, x in enumerate(spaces) if x >= s]
        if fits:
            i = min(fits, key=lambda i: spaces[i])
            spaces[i] -= s
        else:
            spaces.append(capacity - s)
    return sorted(spaces)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([20, 60, 100])) for _ in range(rng.randint(1, 400))]
    hist = {s: sizes.count(s) for s in set(sizes)}
    load, ranks = {}, {}
    for length, first, items, container, each in plan(hist, 100):
        for r in range(first, first + items):
            c = container + (r - first) // each
            load[c] = load.get(c, 0) + length
            ranks.setdefault(length, []).append(r)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in hist.items()}
    assert sorted(100 - x for x in load.values()) == best_fit(sizes, 100)
    assert sorted(load) == list(range(len(load)))


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 7, 7, 7, 30, rng.randint(1, 99), 100, 101, 350])) for i in range(500)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "doc_id as length", "n_tokens as container")
    got = pack(df, 100).collect()
    by_doc, load = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.offset, r.length))
        load[r.container] = load.get(r.container, 0) + r.length
    for i, n in rows:
        pieces = sorted(by_doc.get(i, []))
        assert sum(x for _, x in pieces) == (n or 0)
        assert [o for o, _ in pieces] == list(range(0, n or 0, 100))
    assert max(load.values()) <= 100
    pieces = [min(100, n - o) for _, n in rows if n for o in range(0, n, 100)]
    assert len(load) == len(best_fit(pieces, 100))


def test_one_length_and_none(spark):
    df = spark.createDataFrame([(i, 33) for i in range(1000)], "doc_id bigint, n_tokens bigint")
    assert pack(df, 100).select("container").distinct().count() == 334
    assert pack(df.limit(0), 100).count() == 0
