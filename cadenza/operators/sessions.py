"""Inactivity sessions from occupancy bitmaps.

Time is cut into blocks of 32,768 seconds. Each (entity, block) holds a bitmap with one bit a second, built and merged on
the JVM side. A morphological closing with the length of the gap, made of shifts of doubling length, joins bits that are
at most the gap apart; the runs of the closed bitmap are the sessions inside the block, their counts come from the
per-second counts. Only the first and last run of a block can continue in a neighbour, so only those (at most two a block)
go through a window by entity; that window's size is bounded by the length of the timeline, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32_768


def closing(bits: int, gap: int) -> int:
    """Fill every hole of fewer than ``gap`` zeros: dilation then erosion by ``gap`` positions, by doubling shifts."""
    width = 1
    while width < gap:
        step = min(width, gap - width)
        bits |= bits << step
        width += step
    width = 1
    while width < gap:
        step = min(width, gap - width)
        bits &= bits >> step
        width += step
    return bits


def _ones(bits: int) -> np.ndarray:
    """Positions of the set bits; only bytes that hold any are looked into."""
    data = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    at = np.flatnonzero(data)
    byte, bit = np.nonzero(np.unpackbits(data[at][:, None], axis=1, bitorder="little"))
    return at[byte] * 8 + bit


def _runs(bitmap: bytes, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of the closed bitmap."""
    closed = closing(int.from_bytes(bitmap, "little"), gap)
    return _ones(closed & ~(closed << 1)), _ones(closed & ~(closed >> 1))


def _block_runs(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(1).to_numpy()
            seen = b.column(3)
            bounds, each = seen.offsets.to_numpy(), seen.values
            at, num = each.field("pos").to_numpy(), each.field("n").to_numpy()
            rows: list[np.ndarray] = []
            for i, bitmap in enumerate(b.column(2).to_pylist()):
                s, e = _runs(bitmap, gap)
                own = slice(bounds[i], bounds[i + 1])
                order = np.argsort(at[own])
                pos, total = at[own][order], np.concatenate([[0], np.cumsum(num[own][order])])
                n = total[np.searchsorted(pos, e, "right")] - total[np.searchsorted(pos, s, "left")]
                edge = np.zeros(len(s), np.int64)
                edge[[0, -1]] = 1
                rows.append(np.stack([np.full(len(s), i), s + block[i] * BLOCK, e + block[i] * BLOCK, n, edge]))
            if rows:
                i, s, e, n, edge = np.concatenate(rows, axis=1)
                cols = [b.column(0).take(pa.array(i)), pa.array(block[i]), pa.array(s), pa.array(e), pa.array(n), pa.array(edge > 0)]
                yield pa.RecordBatch.from_arrays(cols, ["entity", "block", "s", "e", "n", "edge"])

    return run


def sessions(events: DataFrame, entity: Column, second: Column, gap: int = 1800) -> DataFrame:
    """(entity, start_s, end_s, n_events): sessions of ``entity`` split where the next event is more than ``gap`` seconds
    later. ``second`` is an epoch second. Rows whose entity or second is null belong to no session; repeated rows count
    in n_events; an empty table gives an empty table. Other columns are ignored, whatever their names. A gap of a block or
    more makes every block one run; what is left to join are the runs of neighbouring blocks."""
    if gap < 1:
        raise ValueError("gap must be a second or more")
    per_second = (
        events.select(entity.alias("entity"), second.cast("bigint").alias("sec"))
        .where("entity is not null and sec is not null")
        .groupBy("entity", "sec")
        .agg(F.count("*").alias("n"))
    )
    block = F.floor(F.col("sec") / F.lit(BLOCK)).cast("bigint")
    at = (F.col("sec") - block * BLOCK).cast("bigint")
    blocks = per_second.select("entity", block.alias("block"), at.alias("pos"), "n").groupBy("entity", "block").agg(
        F.bitmap_construct_agg("pos").alias("bitmap"), F.collect_list(F.struct("pos", "n")).alias("seen")
    )
    runs = blocks.mapInArrow(_block_runs(min(gap, BLOCK)), "entity string, block bigint, s bigint, e bigint, n bigint, edge boolean")
    # inner runs are whole already: each is its own group, so that only edge runs meet in a window
    runs = runs.withColumn("part", F.when(F.col("edge"), F.lit(None)).otherwise(F.col("s")))
    w = Window.partitionBy("entity", "part").orderBy("s")
    fresh = F.coalesce(F.col("s") - F.lag("e").over(w) > gap, F.lit(True)).cast("int")
    return (
        runs.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(w))
        .groupBy("entity", "part", "run")
        .agg(F.min("s").alias("start_s"), F.max("e").alias("end_s"), F.sum("n").alias("n_events"))
        .select("entity", "start_s", "end_s", "n_events")
    )
