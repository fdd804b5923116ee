"""Filling containers of fixed capacity (problem 9).

A plan is made over the histogram of lengths, at most ``capacity`` numbers however large the corpus is: best fit, longest
first, over counts. A step places many items of one length into many equal containers. Pieces then take their slots by a
join on their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, items, first container, items a container) for the given counts of lengths.

    Each item goes into the open container with the least space that takes it, else into a new one. Containers that are
    alike are handled as one group, so the work depends on the number of different lengths only.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    spaces: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    used = 0

    def put(space: int, first: int, count: int) -> None:
        if count and space:
            if space not in groups:
                insort(spaces, space)
            groups.setdefault(space, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop(at)
            else:
                space, first = capacity, used
                count = -(-left // (capacity // length))
                used += count
            each = space // length
            full = min(count, left // each)
            rest = min(left - full * each, each) if full < count else 0
            if full:
                slots.append((length, rank, full * each, first, each))
                put(space - each * length, first, full)
            if rest:
                slots.append((length, rank + full * each, rest, first + full, rest))
                put(space - rest * length, first + full, 1)
            put(space, first + full + bool(rest), count - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return slots


def pack(sizes: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(container, doc_id, offset, length): every item of ``sizes`` in containers that hold ``capacity``.

    Only an item larger than the capacity is split: into full pieces and one rest; offset is where a piece begins in its
    item. Items of size 0 or null take no room and have no row. Repeated rows are items of their own. The rank within a
    length is a rank within a salted part of it plus the sizes of the parts before, so one length may hold most items.
    """
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.col(size).cast("bigint")
    cut = sizes.where(n > 0).select(F.col(key).alias("doc_id"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(capacity).cast("bigint"))).alias("offset"))
    pieces = cut.select("doc_id", "offset", F.least(F.lit(capacity), F.col("n") - F.col("offset")).cast("int").alias("length"))
    pieces = materialise(pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "offset"), F.lit(parts)).cast("int")), "pieces")
    counts = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan(histogram, capacity), "length int, first_rank bigint, items bigint, first_container bigint, each bigint")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    starts = counts.select("length", "part", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "offset")) - 1
    ranked = pieces.withColumn("inner", inner).join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inner"))
    # the plan has a few slots for each of at most `capacity` lengths
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("length", "len")), F.expr("length = len and rank >= first_rank and rank < first_rank + items"))
    container = F.col("first_container") + F.expr("(rank - first_rank) div each")
    return placed.select(container.alias("container"), "doc_id", "offset", "length")
