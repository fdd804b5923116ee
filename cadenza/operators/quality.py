"""Checks of tables; each is one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import ERAS
from .joins import ContractError, require_columns

COUNTS = ("scrobble_count", "total_scrobbles", "active_days", "unique_artists", "unique_tracks", "scrobbles")


def violations(df: DataFrame, rules: dict[str, Column]) -> dict[str, int]:
    """Rows that break each rule (a rule is true for a good row; null counts as good), in one pass."""
    if not rules:
        return {}
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(f"r{i}") for i, c in enumerate(rules.values())]).first()
    return dict(zip(rules, row, strict=True))


def require(df: DataFrame, rules: dict[str, Column], what: str) -> None:
    if bad := {k: n for k, n in violations(df, rules).items() if n}:
        raise ContractError(f"{what}: " + ", ".join(f"{k} fails in {n} rows" for k, n in bad.items()))


def mart_rules(df: DataFrame) -> dict[str, Column]:
    """What holds in every mart, by its columns: counts are not negative, eras are known, shares are in [0, 1], calendar
    fields are in their ranges."""
    rules = {f"{c} >= 0": F.col(c) >= 0 for c in COUNTS if c in df.columns}
    if "tracking_era" in df.columns:
        rules["known era"] = F.col("tracking_era").isin(*ERAS)
    for c in df.columns:
        if c.endswith("_share") or c in ("hhi", "share_of_year", "share_of_era_scrobbles", "artist_discovery_rate"):
            rules[f"{c} in [0, 1]"] = F.col(c).between(0, 1 + 1e-9)
    for c, low, high in (("month", 1, 12), ("weekday", 0, 6), ("hour", 0, 23), ("local_hour", 0, 23), ("local_weekday", 0, 6)):
        if c in df.columns:
            rules[f"{c} in range"] = F.col(c).between(low, high)
    return rules


def check_events(df: DataFrame, key: str = "scrobble_id", required: Sequence[str] = ("user", "track_name", "artist_name", "scrobbled_at", "source", "bronze_run_id")) -> int:
    """Rows of a canonical event table; raises if a column is missing, the key repeats, a required value is null or the time
    is not an instant."""
    require_columns(df, [key, *required], "events")
    if not isinstance(df.schema["scrobbled_at"].dataType, T.TimestampType):
        raise ContractError("events: scrobbled_at is not an instant")
    row = df.agg(F.count("*"), F.count_distinct(key), *[F.count_if(F.col(c).isNull()) for c in (key, *required)]).first()
    if row[0] != row[1]:
        raise ContractError(f"events: {key} is not unique")
    if bad := [c for c, n in zip((key, *required), row[2:], strict=True) if n]:
        raise ContractError(f"events: null in {', '.join(bad)}")
    return row[0]


def conserved(expected: int, marts: dict[str, tuple[DataFrame, str]]) -> None:
    """Raise unless the counts of each mart add up to the number of events."""
    for name, (df, column) in marts.items():
        got = df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]
        if got != expected:
            raise ContractError(f"{name} counts {got} of {expected} events")
