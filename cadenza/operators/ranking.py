"""Ranks, shares, lifecycles and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with a gap-free row number by ``order`` within ``groups``, for groups of any size.

    The rows are range-partitioned by group and order and written; a row's number is its number within its part of the
    group plus the sizes of the parts before it. So one group spreads over many tasks; what is broadcast has one row for
    each part and group. ``order`` should be total.
    """
    by = [F.col(g) for g in groups]
    parts = materialise(df.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    local = parts.withColumn("__n", F.row_number().over(Window.partitionBy(*groups, "__p").orderBy(*order)))
    sizes = parts.groupBy(*groups, "__p").agg(F.count("*").alias("__k"))
    before = sizes.withColumn("__b", F.sum("__k").over(Window.partitionBy(*groups).orderBy("__p")) - F.col("__k")).drop("__k")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*groups, "__p")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = local.alias("l").join(before.alias("r"), on)
    return out.select("l.*", "r.__b").withColumn(name, (F.col("__n") + F.col("__b")).cast("int")).drop("__n", "__p", "__b")


def top_shares(counts: DataFrame, groups: Sequence[str], entity: str, n: str, ks: Sequence[int], names: Sequence[str]) -> DataFrame:
    """(groups, <names>): the share of the k largest entities in each group's total. Only the max(ks) largest of a group meet:
    the rank filter cuts each task's rows before the shuffle."""
    order = Window.partitionBy(*groups).orderBy(F.desc(n), F.asc(entity))
    top = counts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= max(ks))
    sums = top.groupBy(*groups).agg(*[F.sum(F.when(F.col("__r") <= k, F.col(n))).alias(c) for k, c in zip(ks, names, strict=True)])
    total = counts.groupBy(*groups).agg(F.sum(n).alias("__t"))
    shares = {c: F.col(c) / F.col("__t") for c in names}
    return sums.join(total, list(groups)).withColumns(shares).drop("__t")


def hhi(n: str = "n") -> Column:
    """Sum of squared shares, by integers until the last division."""
    x = F.col(n).cast("decimal(19,0)")
    return F.sum(x * x).cast("double") / (F.sum(n).cast("double") * F.sum(n).cast("double"))


def lifecycle(key: str, year: str = "year") -> Column:
    """new, resurgent (last active three or more years before), persistent (active in both years before) or returning, from
    the years in which the key is active. A RANGE frame, so several rows of one key and year count as one year."""
    w = Window.partitionBy(key).orderBy(year)
    previous = F.max(year).over(w.rangeBetween(Window.unboundedPreceding, -1))
    one = F.count("*").over(w.rangeBetween(-1, -1)) > 0
    two = F.count("*").over(w.rangeBetween(-2, -2)) > 0
    return F.when(previous.isNull(), "new").when(previous <= F.col(year) - 3, "resurgent").when(one & two, "persistent").otherwise("returning")


def streaks(dates: DataFrame, date: str = "date") -> DataFrame:
    """(start_date, end_date, days): maximal runs of consecutive dates. One row for each different date, so the single window
    is bounded by the length of the calendar. Null dates are left out."""
    d = dates.select(F.col(date).alias("d")).where("d is not null").distinct()
    island = F.date_sub("d", F.row_number().over(Window.orderBy("d")))
    runs = d.withColumn("island", island).groupBy("island").agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.count("*").alias("days"))
    return runs.drop("island")
