import random

import numpy as np
import pyarrow as pa
import pytest
from cadenza.llm.codepoints import utf8
from cadenza.llm.history import ChunkHistory, chunk_table, covered, cut, records_of, repeated_deliveries
from cadenza.llm.titles import same_title, title_key

SCHEMA = "row_no bigint, user string, t bigint, run string, artist bigint, title string"
S = 1_000_000


def rows_of(seed, n=300):
    rng = random.Random(seed)
    titles = [title_key(x) for x in ("Frozen Café", "Frozen Cafe", "Frzoen Café", "Paper Meadow, Pt. 1", "Paper Meadow, Pt. 2", "Paper Meadow (Live)", "X")]
    out = []
    for i in range(n):
        out.append((i, rng.choice("uv"), (rng.randint(0, 40) * 100 + rng.choice([0, 0, 7, 29])) * S, f"run{i // 30:02d}", rng.choice([1, 2]), rng.choice(titles)))
    return out


def brute(rows):
    n = len(rows)
    of = list(range(n))
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[1] == b[1] and a[4] == b[4] and abs(a[2] - b[2]) <= 30 * S and same_title(a[5], b[5]) and of[i] != of[j]:
                x, y = of[i], of[j]
                of = [y if c == x else c for c in of]
    out = set()
    for c in set(of):
        own = [rows[i] for i in range(n) if of[i] == c]
        first, run = min(r[0] for r in own), min(r[3] for r in own)
        out |= {(first, r[0]) for r in own if r[3] > run}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("batches", [1, 3])
def test_against_brute_force(spark, tmp_path, batches):
    rows = rows_of(batches)
    got = repeated_deliveries(frame(spark, rows), ChunkHistory(spark, str(tmp_path)), batches)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_a_play_without_end(spark, tmp_path):
    rows = [(i, "u", 0, f"run{i % 7}", 1, title_key("Song")) for i in range(2000)]
    got = repeated_deliveries(frame(spark, rows), ChunkHistory(spark, f"{tmp_path}/h")).collect()
    assert len(got) == sum(r[3] > "run0" for r in rows)
    assert {r.row_no_a for r in got} == {0}
    assert repeated_deliveries(frame(spark, []), ChunkHistory(spark, f"{tmp_path}/e")).count() == 0


def test_runs_one_by_one_in_new_sessions(spark, tmp_path):
    """The history is found where an earlier object left it; equal instants of one play are accepted once."""
    rows = rows_of(5, 120)
    for run in sorted({r[3] for r in rows}):
        h = ChunkHistory(spark, str(tmp_path))
        h.check(frame(spark, [r for r in rows if r[3] == run]))
        h.append()
    assert {tuple(r) for r in ChunkHistory(spark, str(tmp_path)).deliveries().collect()} == brute(rows)
    kept = spark.read.parquet(f"{tmp_path}/records").collect()
    for x in kept:
        assert not any(x.id < y.id and x.user == y.user and x.t == y.t and x.artist == y.artist and same_title(x.title, y.title) for y in kept)
    for r in rows:
        assert any(x.user == r[1] and x.t == r[2] and x.artist == r[4] and same_title(x.title, r[5]) for x in kept)


def test_coverage_decides(spark, tmp_path):
    """Of records in one context, those without enough common bytes never reach the exact check; the share is a parameter."""
    first = [(1, "u", 0, "r1", 1, title_key("Cat")), (2, "u", 100 * S, "r1", 1, title_key("Frozen Meadow"))]
    then = [(3, "u", 5 * S, "r2", 1, title_key("Zebra Crossing Over")), (4, "u", 101 * S, "r2", 1, title_key("Frzoen Meadow")), (5, "u", 105 * S, "r2", 1, title_key("Pilot"))]
    for coverage, want in ((0.25, {(2, 4)}), (0.95, set())):
        h = ChunkHistory(spark, f"{tmp_path}/{coverage}", coverage=coverage)
        h.check(frame(spark, first))
        h.append()
        assert {(r.a, r.b) for r in h.check(frame(spark, then)).collect()} == want
    old, new = (chunk_table(records_of(frame(spark, r)), 30) for r in (first, then))
    pairs = spark.createDataFrame([(1, 3, 1), (2, 4, 9)], "x bigint, y bigint, shared bigint")
    assert [(r.x, r.y) for r in covered(pairs, old, new, 0.25).collect()] == [(1, 3), (2, 4)]
    assert [(r.x, r.y) for r in covered(pairs, old, new, 0.5).collect()] == [(2, 4)]


def test_reads_own_slots_only(spark, tmp_path):
    """What is read for a batch does not grow with history of other times, whosever it is."""
    day = 86_400 * S
    h = ChunkHistory(spark, str(tmp_path))
    h.check(frame(spark, [(1, "u", 0, "r1", 1, title_key("Song"))]))
    h.append()
    new = records_of(frame(spark, [(99_999, "u", 9 * S, "r9", 1, title_key("Song"))]))
    before = sorted(h.near(new).inputFiles())
    h.check(frame(spark, [(i, "uvw"[i % 3], i * day, "r2", 1, title_key(f"Song {i}")) for i in range(40, 600)]))
    h.append()
    assert sorted(h.near(new).inputFiles()) == before
    assert h.near(records_of(frame(spark, [(1, "u", -900 * day, "r9", 1, title_key("Song"))]))) is None


def test_cut():
    texts = ["abcdef", "", "abcdefgh", "é" * 50]
    data, offs = utf8(pa.array(texts))
    record, start, stop, h = cut(data, offs)
    for i, t in enumerate(texts):
        own = np.flatnonzero(record == i)
        assert b"".join(bytes(data[start[k] : stop[k]]) for k in own) == t.encode()
    first = [[int(h[k]) for k in np.flatnonzero(record == i)] for i in (0, 2)]
    assert first[0][0] == first[1][0]
