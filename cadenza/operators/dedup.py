"""Keep-first deduplication, merging, and membership joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by ``order``, which should be total. Nulls in a key are equal; nulls sort first.

    The rank filter becomes a group limit before the shuffle, so of a key repeated without end one row a task travels.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") == 1).drop("__n")


def merge_first(existing: DataFrame | None, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Both tables together, the first row of each key kept: an existing row wins only by the order, not by being there."""
    return keep_first(new if existing is None else existing.unionByName(new), keys, order)


def absent(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in ``seen``. A null key is in nothing."""
    return df.join(seen.select(*keys), list(keys), "left_anti")


def present(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are in ``seen``, each once."""
    return df.join(seen.select(*keys), list(keys), "left_semi")
