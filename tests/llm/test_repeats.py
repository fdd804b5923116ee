import random

import pyarrow as pa
import pytest
from cadenza.llm.repeats import FIELDS, TYPES, _machine, repeated_runs
from cadenza.llm.titles import same_title, title_key

SCHEMA = "row_no bigint, entity string, t bigint, item bigint, text string"
S = 1_000_000


def brute(rows, gap):
    out, state = [], None
    for row_no, ent, t, item, text in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if state and state[0] == ent and state[1] == item and t - state[5] <= gap * S and (same_title(state[2], text) or same_title(state[3], text)):
            state[3], state[5], state[7] = text, t, row_no
            state[8] += 1
        else:
            if state:
                out.append(tuple(state))
            state = [ent, item, text, text, t, t, row_no, row_no, 1]
    if state:
        out.append(tuple(state))
    return sorted((s[0], s[1], s[4], s[5], s[6], s[7], s[8]) for s in out)


def run(spark, rows, gap=1800):
    got = repeated_runs(spark.createDataFrame(rows, SCHEMA), gap).collect()
    return sorted((r.entity, r.item, r.t0, r.t1, r.row0, r.row1, r.n) for r in got)


def test_random(spark):
    titles = [title_key(x) for x in ("Frozen Café", "Frzoen Cafe (Remastered)", "Paper, Pt. 1", "Paper, Pt. 2", "Paper, Pt. 1 (Live)")]
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(i, rng.choice("ab"), rng.randint(0, 400) * 300 * S, rng.choice([1, 1, 2]), rng.choice(titles[: rng.choice([1, 2, 5])])) for i in range(400)]
        assert run(spark, rows) == brute(rows, 1800)


def test_one_hot_entity_over_all_tasks(spark):
    """One run longer than any partition: its fragments are put together again."""
    rows = [(i, "a", i * 60 * S, 1, title_key("Song" if i % 9 else "Sogn")) for i in range(3000)]
    assert [r[-1] for r in run(spark, rows)] == [3000]


def test_edges(spark):
    k = title_key("x")
    assert run(spark, []) == []
    rows = [(1, "a", 0, 1, k), (2, "a", 1800 * S, 1, k), (3, "a", 3601 * S, 1, k), (4, "a", 3601 * S, 1, k), (4, "a", 3601 * S, 1, k)]
    assert [r[-1] for r in run(spark, rows)] == [2, 3]


EVENT = pa.schema([("entity", pa.string()), ("item", pa.int64()), ("text", pa.string()), ("t", pa.int64()), ("row_no", pa.int64())])


def by_parts(parts, same, gap=1800):
    """The two passes over partitions given as lists of events (entity, item, text, t, row)."""
    out, edges = [], []
    for part in parts:
        half = len(part) // 2  # a partition comes in several batches
        batches = [pa.RecordBatch.from_pylist([dict(zip(EVENT.names, r, strict=True)) for r in rows], EVENT) for rows in (part[:half], part[half:]) if rows]
        for b in _machine(gap * S, same, False)(iter(batches)):
            for r in b.to_pylist():
                (edges if r["edge"] else out).append(r)
    schema = pa.schema(list(zip(FIELDS, TYPES, strict=True)))
    for b in _machine(gap * S, same, True)(iter([pa.RecordBatch.from_pylist([e], schema) for e in edges])):
        out += b.to_pylist()
    return sorted((r["row0"], r["row1"], r["n"]) for r in out)


def slips(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) <= 1


def test_no_cut_makes_a_difference():
    """An anchor with two slips of it that are no slips of each other, then another track: wherever the partitions are cut."""
    rows = [("a", 1, x, i * 60 * S, i) for i, x in enumerate(("song", "sung", "sonk", "bell"))]
    assert by_parts([rows], slips) == [(0, 2, 3), (3, 3, 1)]
    for k in range(1, 4):
        assert by_parts([rows[:k], rows[k:]], slips) == by_parts([rows], slips)
        for m in range(k + 1, 4):
            assert by_parts([rows[:k], rows[k:m], rows[m:]], slips) == by_parts([rows], slips)


@pytest.mark.parametrize("seed", range(30))
def test_random_cuts(seed):
    rng = random.Random(seed)
    texts = ["aaa", "aab", "abb", "bbb", "abc"]
    t, rows = 0, []
    for i in range(60):
        t += rng.choice([60, 60, 60, 1800, 1801]) * S
        rows.append((("u", "v")[i >= 40], rng.choice([1, 1, 1, 1, 2]), rng.choice(texts), t, i))
    cuts = sorted(rng.sample(range(1, 60), rng.randint(1, 12)))
    parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, 60], strict=True)]
    assert by_parts(parts, slips) == by_parts([rows], slips)
