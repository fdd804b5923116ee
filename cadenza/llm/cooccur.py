"""Items that appear together (problem 5): heavy-light decomposition.

Baskets are numbered in blocks of 32,768. A frequent item has one bitmap for each block, a row of a dense bit matrix; pairs of
frequent items are counted by the population count of two rows' AND. Of a mixed pair the rare item's list probes the frequent
items' bitmaps. Pairs of rare items come from a join of their lists by basket and are counted by hash. Partial counts of
blocks are summed. Items below the least count cannot be in a counted pair and are left out first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

BLOCK, PROBES = 32_768, 500_000
PAIR = "a string, b string, n bigint"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, first = 0, TaskContext.get().partitionId() << 32
    for b in batches:
        at = np.arange(seen, seen + len(b))
        seen += len(b)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first + at // BLOCK), pa.array(at % BLOCK)], ["basket", "block", "bit"])


def block_counts(matrix: np.ndarray, names: np.ndarray, light: np.ndarray, bits: np.ndarray, inner: bool = True) -> tuple[list, list, list]:
    """(a, b, n) with a < b: pairs of the items ``names`` with the bit rows ``matrix`` (items x bytes), and of these with the
    rare items: ``light`` and ``bits`` are parallel, one entry for each basket a rare item stands in. Pairs of the matrix
    itself are counted only if ``inner``."""
    out: tuple[list, list, list] = ([], [], [])

    def put(name: str, others: np.ndarray, n: np.ndarray) -> None:
        for x, k in zip(others[n > 0].tolist(), n[n > 0].tolist(), strict=True):
            out[0].append(min(name, x))
            out[1].append(max(name, x))
            out[2].append(k)

    words = matrix.view(np.uint64)
    for i in range(len(names) - 1 if inner else 0):
        put(names[i], names[i + 1 :], np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64))
    if len(names) and len(light):
        order = np.argsort(light, kind="stable")
        light, bits = light[order], bits[order]
        starts = np.flatnonzero(np.concatenate([[True], light[1:] != light[:-1]]))
        total = np.zeros((len(names), len(starts)), np.int64)
        for i in range(0, len(bits), 65_536):  # a slice of the lists at a time
            part = bits[i : i + 65_536]
            hit = (matrix[:, part >> 3] >> (part & 7).astype(np.uint8)) & 1
            owner = np.searchsorted(starts, np.arange(i, i + len(part)), "right") - 1
            cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            total[:, owner[cut]] += np.add.reduceat(hit, cut, axis=1, dtype=np.int64)
        for k, s in enumerate(starts):
            put(light[s], names, total[:, k])
    return out


def _count_block(left: pa.Table, right: pa.Table) -> pa.Table:
    matrix = np.frombuffer(b"".join(left["bitmap"].to_pylist()), np.uint8).reshape(len(left), -1) if len(left) else np.zeros((0, BLOCK // 8), np.uint8)
    names = np.array(left["item"].to_pylist(), dtype=object)
    inner = len(left) > 0 and left["part"][0].as_py() == 0
    a, b, n = block_counts(matrix, names, np.array(right["item"].to_pylist(), dtype=object), right["bit"].to_numpy().astype(np.int64), inner)
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "n": pa.array(n, pa.int64())})


def _light_pairs(light: DataFrame, least: int) -> DataFrame:
    """(a, b, n) of pairs of rare items. An item makes no pairs in its ``least - 1`` largest baskets: what it has in common with
    another in ``least`` baskets stands in one of the others too, and such pairs then only probe the large ones. So a basket
    that holds a great part of all rows makes pairs of those of its items only that have as large ones besides."""
    basket = ["block", "bit"]
    sizes = light.groupBy(*basket).agg(F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("size"), *basket))  # a rare item has few baskets
    ranked = materialise(light.join(sizes, basket).select(*basket, "item", (place < least).alias("large")), "ranked")
    a = ranked.select(*basket, F.col("item").alias("a"), "large")
    b = ranked.select(*basket, F.col("item").alias("b"))
    near = materialise(a.where("not large").join(b, basket).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")), "near")
    more = near.select("a", "b").join(a.where("large").select(*basket, "a"), "a").join(b, [*basket, "b"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    return near.unionByName(more)


def pair_counts(baskets: DataFrame, basket: Column, item: Column, least: int = 1, heavy_share: float = 1 / 64) -> DataFrame:
    """(a, b, n_a, n_b, n_ab, n_baskets), a < b by code points, for the pairs in at least ``least`` baskets.

    A basket is the set of different non-blank items; rows with a null basket or a null or blank item say nothing; repeated
    rows count once; an empty table gives an empty table. An item is frequent if it stands in ``heavy_share`` of all baskets
    or more, so there are at most (mean basket size) / heavy_share of them.
    """
    rows = baskets.select(basket.cast("string").alias("basket"), item.cast("string").alias("item"))
    rows = materialise(rows.where(F.col("basket").isNotNull() & F.col("item").rlike(r"(?U)[^\s]")).distinct(), "incidence")
    numbered = materialise(rows.select("basket").distinct().mapInArrow(_number, "basket string, block bigint, bit bigint"), "baskets")
    total = numbered.count()
    items = rows.groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least)
    items = materialise(items.withColumn("heavy", F.col("n_item") >= heavy_share * total), "items")
    placed = materialise(rows.join(items.select("item", "heavy"), "item").join(numbered, "basket").select("block", "bit", "item", "heavy"), "placed")
    matrix = placed.where("heavy").groupBy("block", "item").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    light = placed.where("not heavy").select("block", "bit", "item")
    # the lists that probe one block's matrix are split by item when they are long; the matrix goes along with each part
    parts = light.groupBy("block").agg(F.ceil(F.count("*") / F.lit(PROBES)).cast("int").alias("parts"))
    each = matrix.join(parts, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    lists = light.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    own = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])  # noqa: E731  (both sides come from one table)
    sides = own(each, "block", "part", "item", "bitmap"), own(lists, "block", "part", "item", "bit")
    blocks = sides[0].groupBy("block", "part").cogroup(sides[1].groupBy("block", "part")).applyInArrow(_count_block, PAIR)
    pairs = blocks.unionByName(_light_pairs(light, least)).groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    sizes = items.select("item", "n_item")
    return pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").select("a", "b", "n_a", "n_b", "n_ab", F.lit(total).cast("bigint").alias("n_baskets"))


def lifted(pairs: DataFrame, factor: int) -> DataFrame:
    """The pairs that stand together at least ``factor`` times as often as chance would have it."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(big("n_ab") * big("n_baskets") >= big("n_a") * big("n_b") * factor)
