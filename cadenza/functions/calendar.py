"""Calendar fields, eras and local time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL, CONSISTENT = "partial_tracking", "consistent_tracking"
ERAS = (PARTIAL, CONSISTENT)


def calendar(df: DataFrame, ts: str = "scrobbled_at") -> DataFrame:
    """date, year, month, hour and weekday (0 = Monday) of a timestamp in the session's time zone, which is UTC."""
    t = F.col(ts)
    return df.withColumns({"date": F.to_date(t), "year": F.year(t), "month": F.month(t), "weekday": F.weekday(t), "hour": F.hour(t)})


def era(ts: str | Column, boundary: datetime | str) -> Column:
    """The era of an instant; the boundary itself is in the later one. The boundary must be 1 January, 00:00 UTC, because
    yearly marts have one row for a year and era. Null has no era."""
    at = datetime.fromisoformat(boundary) if isinstance(boundary, str) else boundary
    at = at.astimezone(timezone.utc) if at.tzinfo else at
    if (at.month, at.day, at.hour, at.minute, at.second) != (1, 1, 0, 0, 0):
        raise ValueError("the era boundary must be the first instant of a year in UTC")
    t = F.col(ts) if isinstance(ts, str) else ts
    border = F.timestamp_seconds(F.lit(int(at.replace(tzinfo=timezone.utc).timestamp())))
    return F.when(t.isNull(), None).when(t >= border, CONSISTENT).otherwise(PARTIAL)


@dataclass(frozen=True)
class Period:
    """A stretch of time spent in one place: [start, end) as instants; None is open."""

    period: str
    location: str
    zone: str
    start: datetime | None
    end: datetime | None


def periods_of(config: dict) -> list[Period]:
    """Periods of a config with "boundaries" (local datetime and zone by name) and "periods" that refer to them."""
    at = {k: datetime.fromisoformat(b["local_datetime"]).replace(tzinfo=ZoneInfo(b["timezone"])).astimezone(timezone.utc) for k, b in config["boundaries"].items()}
    return [
        Period(p["period"], p["location"], p["timezone"], at[p["start_boundary"]] if p.get("start_boundary") else None, at[p["end_boundary"]] if p.get("end_boundary") else None)
        for p in config["periods"]
    ]


def local_time(df: DataFrame, periods: list[Period], ts: str = "scrobbled_at") -> DataFrame:
    """timezone_period, location, timezone_name, scrobbled_at_local (without zone) and its date, year, month, day, hour and
    weekday. The first period that holds an instant counts; an instant in none raises when it is computed. The periods are a
    chain of conditions, so nothing is joined."""
    t = F.col(ts)
    inside = []
    for p in periods:
        c = F.lit(True)
        for edge, op in ((p.start, "__ge__"), (p.end, "__lt__")):
            if edge is not None:
                c = c & getattr(t, op)(F.timestamp_seconds(F.lit(int(edge.timestamp()))))
        inside.append(c)

    def pick(field: str) -> Column:
        out = F.when(t.isNull(), F.lit(None).cast("string"))
        for c, p in zip(inside, periods, strict=True):
            out = out.when(c, F.lit(getattr(p, field)))
        return out.otherwise(F.raise_error(F.lit("an event lies in no configured period")).cast("string"))

    df = df.withColumns({"timezone_period": pick("period"), "location": pick("location"), "timezone_name": pick("zone")})
    local = F.convert_timezone(F.lit("UTC"), F.col("timezone_name"), F.to_utc_timestamp(t, F.current_timezone()).cast("timestamp_ntz"))
    df = df.withColumn("scrobbled_at_local", local)
    x = F.col("scrobbled_at_local")
    parts = {"date": F.to_date(x), "year": F.year(x), "month": F.month(x), "day": F.dayofmonth(x), "hour": F.hour(x), "weekday": F.weekday(x)}
    return df.withColumns({f"local_{k}": v for k, v in parts.items()})
