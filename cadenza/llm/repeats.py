"""Runs of the same event in ordered sequences (problem 2).

The rows are range-partitioned by entity, time and row, so that a hot entity spreads over many tasks. A state machine
streams through each sorted partition with one run open at a time and compares each event with the run's anchor (its first
event) and its latest event. Where another entity, another item or too long a gap comes, a run ends whatever came before;
up to the first such break a partition doesn't know the run it continues, so it hands its events on as they are, equal
neighbours put together, and at its end the run that is open. The same machine goes through these in order afterwards, so
the result doesn't depend on where partitions are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..storage import materialise
from .titles import same_title

FIELDS = ["entity", "item", "anchor", "latest", "t0", "t1", "row0", "row1", "n", "fresh", "edge", "part", "seq"]
TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64()]
SCHEMA = "entity string, item bigint, anchor string, latest string, t0 bigint, t1 bigint, row0 bigint, row1 bigint, n bigint, fresh boolean, edge boolean, part int, seq bigint"
ENT, ITEM, ANCHOR, LATEST, T0, T1, ROW0, ROW1, N, FRESH = range(10)


def _equal_neighbours(b: pa.RecordBatch, gap: int) -> Iterator[list]:
    """Events (entity, item, text, t, row) as fragments: neighbours equal in entity, item and text at most ``gap`` apart are one."""
    n = len(b)
    codes = [b.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in (0, 1, 2)]
    t, row = b.column(3).to_numpy(), b.column(4).to_numpy()
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes]) | (t[1:] - t[:-1] > gap)
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    at = pa.array(first)
    ent, item, text = (b.column(k).take(at).to_pylist() for k in (0, 1, 2))
    size = (last - first + 1).tolist()
    for e, i, x, t0, t1, r0, r1, k in zip(ent, item, text, t[first].tolist(), t[last].tolist(), row[first].tolist(), row[last].tolist(), size, strict=True):
        yield [e, i, x, x, t0, t1, r0, r1, k, False]


def _machine(gap: int, same: Callable[[str, str], bool], joins: bool):
    """joins: the input rows are what the first pass handed on instead of events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        done: list[list] = []
        state: list | None = None
        known, seq = joins, 0  # whether the run that is open is known from its start

        def end(edge: bool) -> None:
            nonlocal seq
            done.append([*state, edge, part, seq])
            seq += 1

        for b in batches:
            rows = (list(r[:10]) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)) if joins else _equal_neighbours(b, gap)
            for x in rows:
                if state is None:
                    state = x
                    continue
                certain = x[FRESH] or state[ENT] != x[ENT] or state[ITEM] != x[ITEM] or x[T0] - state[T1] > gap
                if not certain and (state[LATEST] == x[ANCHOR] == x[LATEST] or known and (same(state[ANCHOR], x[ANCHOR]) or same(state[LATEST], x[ANCHOR]))):
                    state[LATEST], state[T1], state[ROW1] = x[LATEST], x[T1], x[ROW1]
                    state[N] += x[N]
                    continue
                end(not known)
                known = known or certain
                state = x
                state[FRESH] = known
            if len(done) > 20_000:
                yield _batch(done)
                done = []
        if state:
            end(True)
        if done:
            yield _batch(done)

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], FIELDS)


def runs_of(rows: DataFrame, gap_s: int, same: Callable[[str, str], bool]) -> DataFrame:
    """The runs of rows (entity, item, text, t, row_no) that are sorted within partitions and whose partitions follow each
    other in that order."""
    found = materialise(rows.mapInArrow(_machine(gap_s * 1_000_000, same, False), SCHEMA), "runs")
    edges = found.where("edge").repartition(1).sortWithinPartitions("part", "seq")
    joined = edges.mapInArrow(_machine(gap_s * 1_000_000, same, True), SCHEMA)
    return found.where("not edge").unionByName(joined).select("entity", "item", "anchor", "t0", "t1", "row0", "row1", "n")


def repeated_runs(events: DataFrame, gap_s: int = 1800, same: Callable[[str, str], bool] = same_title) -> DataFrame:
    """(entity, item, anchor, t0, t1, row0, row1, n): every maximal run of one or more neighbouring events of an entity, by
    (t, row_no), with the same item, texts that ``same`` accepts, and steps of at most ``gap_s`` seconds. t in microseconds.

    ``events`` has row_no, entity, t, item, text and is read from a written table, because range partitioning samples it
    first. Repeated rows are events of their own; an empty table gives an empty table. What a partition hands on is its
    events before the first certain break; the second pass streams through them with one run in memory.
    """
    rows = events.select("entity", "item", "text", "t", "row_no").repartitionByRange("entity", "t", "row_no").sortWithinPartitions("entity", "t", "row_no")
    return runs_of(rows, gap_s, same)
