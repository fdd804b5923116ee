import random

import pytest
from cadenza.operators.sessions import BLOCK, closing, sessions
from pyspark.sql import functions as F


def brute(rows, gap):
    out, by = [], {}
    for u, s in rows:
        if u is not None and s is not None:
            by.setdefault(u, []).append(s)
    for u, ss in by.items():
        ss.sort()
        start = last = ss[0]
        n = 0
        for s in ss:
            if s - last > gap:
                out.append((u, start, last, n))
                start, n = s, 0
            last, n = s, n + 1
        out.append((u, start, last, n))
    return sorted(out)


def run(spark, rows, gap):
    df = spark.createDataFrame(rows, "entity string, n bigint")  # clashing names on purpose
    return sorted(map(tuple, sessions(df, F.col("entity"), F.col("n"), gap).collect()))


def test_closing():
    assert closing(0b1000001, 6) == 0b1111111
    assert closing(0b10000001, 6) == 0b10000001
    assert closing(0, 5) == 0


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-3 * BLOCK, 3 * BLOCK), rng.randint(0, 5000)])) for _ in range(400)]
    assert run(spark, rows, 600) == brute(rows, 600)


def test_edges(spark):
    # a chain over several blocks, the gap itself, one second more, repeated rows, a block's first and last second
    rows = [("x", s) for s in range(0, 3 * BLOCK, 1800)] + [("y", 0), ("y", 1800), ("y", 3601), ("y", 3601), ("z", BLOCK - 1), ("z", BLOCK), ("z", BLOCK + 1801)]
    assert run(spark, rows, 1800) == brute(rows, 1800)


def test_empty_and_null(spark):
    assert run(spark, [], 1800) == []
    assert run(spark, [(None, 1), ("a", None)], 1800) == []
    with pytest.raises(ValueError):
        run(spark, [], 0)


@pytest.mark.parametrize("gap", [BLOCK - 1, BLOCK, BLOCK + 1, 43_200, 7 * BLOCK])
def test_gaps_of_a_block_and_more(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice("ab"), rng.randint(0, 60 * gap)) for _ in range(120)] + [("c", 5), ("c", 5 + gap), ("c", 6 + 2 * gap)]
    assert run(spark, rows, gap) == brute(rows, gap)
