"""Joins with a contract on their cardinality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks what a join or a mart relies on."""


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"{what} lacks {', '.join(missing)}")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise if a key stands twice or is null."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    if not bad.isEmpty():
        raise ContractError(f"{what}: {', '.join(keys)} is not a unique key")


def many_to_one(facts: DataFrame, dimension: DataFrame, keys: Sequence[str], what: str, validate: bool = True) -> DataFrame:
    """``facts`` with the columns of ``dimension``, one row for each fact. With ``validate``, a key that stands twice in the
    dimension or a fact without partner raises. Catalyst decides between broadcast and shuffle by the dimension's size."""
    if validate:
        require_unique(dimension, keys, what)
        if not facts.select(*keys).distinct().join(dimension, list(keys), "left_anti").isEmpty():
            raise ContractError(f"{what}: facts without a row in the dimension")
    return facts.join(dimension, list(keys), "left")


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Inner join of two tables that both have ``keys`` as a unique key."""
    require_unique(a, keys, f"{what}, left")
    require_unique(b, keys, f"{what}, right")
    return a.join(b, list(keys))
