"""The eight activity marts. Each builder is a plan from a DataFrame to a DataFrame.

Seven of them come from one shared aggregate at the grain of artist, track, date and era; only the hourly mart reads events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import CONSISTENT, calendar, era
from ..operators import quality
from ..operators.ranking import rank_within, streaks, top_shares

BOUNDARY = "2020-01-01T00:00:00+00:00"
YE = ["year", "tracking_era"]


def prepare(events: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """Events with calendar fields and era. Rows without artist, track or time take no part in marts."""
    kept = events.where("artist_name is not null and track_name is not null and scrobbled_at is not null")
    return calendar(kept).withColumn("tracking_era", era("scrobbled_at", boundary))


def base(prepared: DataFrame) -> DataFrame:
    """(artist_name, track_name, date, year, month, weekday, tracking_era, n, first_ts, last_ts)."""
    keys = ["artist_name", "track_name", "date", "year", "month", "weekday", "tracking_era"]
    return prepared.groupBy(*keys).agg(F.count("*").alias("n"), F.min("scrobbled_at").alias("first_ts"), F.max("scrobbled_at").alias("last_ts"))


def listening_daily(b: DataFrame) -> DataFrame:
    g = b.groupBy("date", "year", "month", "weekday", "tracking_era")
    return g.agg(F.sum("n").alias("scrobble_count"), F.count_distinct("artist_name").alias("unique_artists"), F.count("*").alias("unique_tracks"))


def _track():
    return F.struct("artist_name", "track_name")


def listening_monthly(b: DataFrame) -> DataFrame:
    g = b.groupBy("year", "month", "tracking_era").agg(
        F.sum("n").alias("scrobble_count"), F.count_distinct("date").alias("active_days"), F.count_distinct("artist_name").alias("unique_artists"), F.count_distinct(_track()).alias("unique_tracks")
    )
    label = F.format_string("%04d-%02d", "year", "month")
    g = g.withColumns({"year_month": label, "scrobbles_per_active_day": F.col("scrobble_count") / F.col("active_days")})
    return g.select("year", "month", "year_month", "tracking_era", "scrobble_count", "active_days", "unique_artists", "unique_tracks", "scrobbles_per_active_day")


def _yearly(b: DataFrame) -> DataFrame:
    return b.groupBy(*YE).agg(
        F.sum("n").alias("scrobble_count"), F.count_distinct("date").alias("active_days"), F.count_distinct("artist_name").alias("unique_artists"), F.count_distinct(_track()).alias("unique_tracks")
    )


def first_years(b: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(year, <name>): how many keys occur first in each year of the whole table."""
    return b.groupBy(*keys).agg(F.min("year").alias("year")).groupBy("year").agg(F.count("*").alias(name))


def _new(b: DataFrame, artists: str, tracks: str) -> DataFrame:
    return first_years(b, ["artist_name"], artists).join(first_years(b, ["artist_name", "track_name"], tracks), "year", "full")


def listening_yearly(b: DataFrame) -> DataFrame:
    """One row for a year and era. new_artists and new_tracks occur in no earlier year; the top artist has the most events,
    ties by name."""
    counts = b.groupBy("year", "artist_name").agg(F.sum("n").alias("n"))
    shares = top_shares(counts, ["year"], "artist_name", "n", (1, 5, 10), ("top_1_artist_share", "top_5_artist_share", "top_10_artist_share"))
    top = counts.groupBy("year").agg(F.max("n").alias("top_artist_scrobbles"))
    named = counts.join(top, "year").where("n = top_artist_scrobbles").groupBy("year", "top_artist_scrobbles").agg(F.min("artist_name").alias("top_artist"))
    y = _yearly(b).join(_new(b, "new_artists", "new_tracks"), "year", "left").join(named, "year").join(shares, "year")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("new_artists", "new_tracks")}
    y = y.withColumns(zero).withColumns({"average_scrobbles_per_active_day": F.col("scrobble_count") / F.col("active_days"), "scrobbles_per_unique_artist": F.col("scrobble_count") / F.col("unique_artists")})
    return y.select(
        *YE, "scrobble_count", "active_days", "unique_artists", "unique_tracks", "average_scrobbles_per_active_day", "new_artists", "new_tracks", "top_artist",
        "top_artist_scrobbles", "top_1_artist_share", "top_5_artist_share", "top_10_artist_share", "scrobbles_per_unique_artist",
    )


def artist_stats(b: DataFrame) -> DataFrame:
    """One row for an artist, year and era, with the artist's totals over all years. An artist's window has a row for each of
    its years; the rank within a year spreads over tasks."""
    g = b.groupBy("artist_name", *YE).agg(
        F.sum("n").alias("scrobble_count"), F.count_distinct("track_name").alias("unique_tracks"), F.count_distinct("date").alias("active_days"),
        F.min("first_ts").alias("first_scrobble"), F.max("last_ts").alias("last_scrobble"),
    )
    ranked = rank_within(g, ["year"], [F.desc("scrobble_count"), F.asc("artist_name"), F.asc("tracking_era")], "rank_in_year")
    w = Window.partitionBy("artist_name")
    totals = ranked.groupBy("year").agg(F.sum("scrobble_count").alias("in_year"))
    out = ranked.withColumns({
        "total_scrobbles": F.sum("scrobble_count").over(w), "first_seen": F.min("first_scrobble").over(w), "last_seen": F.max("last_scrobble").over(w),
        "active_years": F.size(F.collect_set("year").over(w)).cast("bigint"), "years_in_top_10": F.count_if(F.col("rank_in_year") <= 10).over(w),
        "years_in_top_50": F.count_if(F.col("rank_in_year") <= 50).over(w),
    }).join(totals, "year").withColumn("share_of_year", F.col("scrobble_count") / F.col("in_year"))
    return out.select(
        "artist_name", *YE, "scrobble_count", "unique_tracks", "active_days", "first_scrobble", "last_scrobble", "rank_in_year", "total_scrobbles", "first_seen",
        "last_seen", "active_years", "years_in_top_10", "years_in_top_50", "share_of_year",
    )


def track_stats(b: DataFrame) -> DataFrame:
    """One row for an artist and track. Days and years are counted by year first, so no distinct count is needed; the peak
    year has the most events, the earliest of equals."""
    by_year = b.groupBy("artist_name", "track_name", "year").agg(
        F.sum("n").alias("n"), F.count_distinct("date").alias("days"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    return by_year.groupBy("artist_name", "track_name").agg(
        F.sum("n").alias("total_scrobbles"), F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen"), F.sum("days").alias("active_days"),
        F.count("*").alias("active_years"), F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"),
    )


def discovery(b: DataFrame) -> DataFrame:
    """Artists and tracks observed first in each year, artists that were there before, and the rate of first ones."""
    active = b.select("artist_name", "year").distinct()
    first = b.groupBy("artist_name").agg(F.min("year").alias("first"))
    back = active.join(first, "artist_name").groupBy("year").agg(F.count_if(F.col("first") < F.col("year")).alias("returning_artists"))
    y = _yearly(b).join(_new(b, "newly_observed_artists", "newly_observed_tracks"), "year", "left").join(back, "year", "left")
    y = y.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("newly_observed_artists", "newly_observed_tracks", "returning_artists")})
    return y.select(
        *YE, F.col("unique_artists").alias("total_unique_artists"), F.col("unique_tracks").alias("total_unique_tracks"), "newly_observed_artists",
        "newly_observed_tracks", "returning_artists", (F.col("newly_observed_artists") / F.col("unique_artists")).alias("artist_discovery_rate"),
    )


def listening_patterns(prepared: DataFrame) -> DataFrame:
    """Events by era, weekday and hour in UTC; cells without events are absent. At most 336 rows, so the window is bounded."""
    g = prepared.groupBy("tracking_era", "weekday", "hour").agg(F.count("*").alias("scrobble_count"), F.count_distinct("artist_name").alias("unique_artists"))
    return g.withColumn("share_of_era_scrobbles", F.col("scrobble_count") / F.sum("scrobble_count").over(Window.partitionBy("tracking_era")))


def listening_streaks(b: DataFrame) -> DataFrame:
    """Runs of consecutive days with events in the later era."""
    return streaks(b.where(F.col("tracking_era") == CONSISTENT)).withColumn("tracking_era", F.lit(CONSISTENT))


#: Column orders in which a mart is sorted when it is published or shown.
SORTED = {
    "listening_daily": ["date", "tracking_era"], "listening_monthly": ["year", "month", "tracking_era"], "listening_yearly": YE,
    "artist_stats": ["year", "rank_in_year"], "track_stats": ["-total_scrobbles", "artist_name", "track_name"], "discovery": YE,
    "listening_patterns": ["tracking_era", "weekday", "hour"], "streaks": ["start_date"],
}


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order])


def build_marts(events: DataFrame, boundary: str = BOUNDARY) -> dict[str, DataFrame]:
    """All marts by name. The shared aggregate is kept in memory or on disk while they are written."""
    prepared = prepare(events, boundary)
    b = base(prepared).persist()
    return {
        "listening_daily": listening_daily(b), "listening_monthly": listening_monthly(b), "listening_yearly": listening_yearly(b), "artist_stats": artist_stats(b),
        "track_stats": track_stats(b), "discovery": discovery(b), "listening_patterns": listening_patterns(prepared), "streaks": listening_streaks(b),
    }


def validate_marts(marts: dict[str, DataFrame], events: int) -> dict:
    """Raise if a mart breaks a rule or the marts do not count every event once."""
    quality.conserved(events, {n: (marts[n], "scrobble_count") for n in ("listening_daily", "listening_yearly")})
    for name, df in marts.items():
        quality.require(df, quality.mart_rules(df), name)
    return {"daily_count": marts["listening_daily"].count(), "monthly_count": marts["listening_monthly"].count(), "yearly_count": marts["listening_yearly"].count(), "silver_conservation": True}


def profile(events: DataFrame, marts: dict[str, DataFrame], boundary: str = BOUNDARY) -> DataFrame:
    """One row: events by era, the longest and the latest streak, the top artist and the top track."""
    eras = prepare(events, boundary).agg(F.count("*").alias("silver_source_rows"), *[F.count_if(F.col("tracking_era") == e).alias(f"{e}_rows") for e in ("partial_tracking", "consistent_tracking")])
    s = marts["streaks"].agg(F.coalesce(F.max("days"), F.lit(0)).alias("longest_streak"), F.coalesce(F.max_by("days", "start_date"), F.lit(0)).alias("latest_streak"))
    tracks = marts["track_stats"]
    artists = tracks.groupBy("artist_name").agg(F.sum("total_scrobbles").alias("n"))
    top_artist = artists.orderBy(F.desc("n"), "artist_name").limit(1).agg(F.first("artist_name").alias("top_artist"))
    top_track = in_order(tracks, SORTED["track_stats"]).limit(1).agg(F.first("track_name").alias("top_track"))
    return one_row(eras, s, top_artist, top_track)


def one_row(*parts: DataFrame) -> DataFrame:
    """Tables of at most one row each, side by side; a union and an aggregate, not a product."""
    columns = [c for p in parts for c in p.columns]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in columns])
