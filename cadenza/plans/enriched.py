"""Events with artist metadata and tags, and the nine enriched marts.

Tags are a bridge: they are aggregated to weights of an artist before they meet counts and never multiply events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import CONSISTENT, PARTIAL, Period, local_time
from ..functions.text import artist_key
from ..operators import joins
from ..operators.ranking import hhi, lifecycle, rank_within, top_shares
from .gold import BOUNDARY, YE, prepare

# Columns of the artist table.
PROFILE = [
    "artist_key", "source_artist_name", "musicbrainz_artist_id", "canonical_name", "artist_type", "country", "area", "begin_area", "resolution_status",
    "resolution_method", "resolution_confidence",
]
MAX_TAGS = 5
ORDER = ("noise", "genre_style", "geography", "era", "descriptor")  # a tag in several lists belongs to the first


def keyed(events: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """Counts of events with artist_key: (artist_name, track_name, date, year, tracking_era, n, first_ts, last_ts, artist_key).
    Events are counted, partly before they are shuffled, and keys are made of the counts; no event is joined by name."""
    keys = ["artist_name", "track_name", "date", "year", "tracking_era"]
    counts = prepare(events, boundary).groupBy(*keys).agg(F.count("*").alias("n"), F.min("scrobbled_at").alias("first_ts"), F.max("scrobbled_at").alias("last_ts"))
    return counts.withColumn("artist_key", artist_key("artist_name"))


def check_bridge(events: DataFrame, artists: DataFrame) -> None:
    """Raise unless every event has exactly one artist."""
    joins.require_columns(artists, ["artist_key", "country"], "artists")
    joins.require_unique(artists, ["artist_key"], "artists")
    if not events.select("artist_key").distinct().join(artists, ["artist_key"], "left_anti").isEmpty():
        raise joins.ContractError("artists: events without a row in the dimension")


def with_artists(events: DataFrame, artists: DataFrame, boundary: str = BOUNDARY, validate: bool = True) -> DataFrame:
    """Every event with its artist's metadata; raises if an artist key repeats or an event has no artist. The marts do not
    need it: they count by artist first and meet the dimension after."""
    if validate:
        joins.require_columns(artists, ["artist_key", "country"], "artists")
    return joins.many_to_one(prepare(events, boundary).withColumn("artist_key", artist_key("artist_name")), artists.select(*[c for c in PROFILE if c in artists.columns]), ["artist_key"], "artists", validate)


def taxonomy_table(spark, config: dict) -> DataFrame:
    """(tag_normalized, tag_category, genre_family) of a config of tag lists, each tag once, by the order of the lists."""
    rows = [(t, "noise", None) for t in config.get("noise", [])]
    rows += [(t, "genre_style", family) for family, tags in config.get("genre_family", {}).items() for t in tags]
    rows += [(t, c, None) for c in ("geography", "era", "descriptor") for t in config.get(c, [])]
    seen: dict[str, tuple] = {}
    for r in rows:
        seen.setdefault(r[0], r)
    return spark.createDataFrame(list(seen.values()), "tag_normalized string, tag_category string, genre_family string")


def classified(tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Tags with tag_category and genre_family; a tag in no list is "other". A taxonomy with a tag twice counts by ORDER."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("tag_category"))
    one = taxonomy.groupBy("tag_normalized").agg(F.min_by(F.struct("tag_category", "genre_family"), F.struct(rank, "genre_family")).alias("t"))
    one = one.select("tag_normalized", "t.tag_category", "t.genre_family")
    return tags.join(one, "tag_normalized", "left").withColumn("tag_category", F.coalesce("tag_category", F.lit("other")))


def tag_weights(tags: DataFrame, taxonomy: DataFrame, most: int = MAX_TAGS) -> DataFrame:
    """The tags of rank ``most`` or better with their category and weight: the inverse rank over the artist's sum of such.

    Rows with a blank or null tag_normalized, or without key or rank, are left out; of a tag that stands twice for an artist
    the best rank stays. An artist's window has at most as many rows as it has tags of these ranks.
    """
    good = tags.where(F.col("artist_key").isNotNull() & F.col("tag_normalized").rlike(r"(?U)[^\s]") & (F.col("tag_rank") <= most))
    good = good.groupBy("artist_key", "tag_normalized").agg(F.min("tag_rank").alias("tag_rank"))
    inverse = F.lit(1.0) / F.greatest("tag_rank", F.lit(1))
    weighed = good.withColumn("inverse", inverse).withColumn("tag_weight", F.col("inverse") / F.sum("inverse").over(Window.partitionBy("artist_key")))
    return classified(weighed, taxonomy).select("artist_key", "tag_normalized", "tag_rank", "tag_category", "genre_family", "tag_weight")


def _best(where=None):
    tag = F.struct("tag_rank", "tag_normalized", "tag_category", "genre_family")
    return F.min(tag if where is None else F.when(where, tag))


def artist_profile(events: DataFrame, artists: DataFrame, weights: DataFrame) -> DataFrame:
    """One row for an artist with events: metadata, totals, its best tag and genre. Events are counted before they meet the
    artists, so no metadata travels with events."""
    totals = events.groupBy("artist_key").agg(
        F.sum("n").alias("total_scrobbles"), F.min("first_ts").alias("first_listen"), F.max("last_ts").alias("last_listen"), F.count_distinct("year").alias("active_years")
    )
    best = weights.groupBy("artist_key").agg(_best().alias("t"), _best(F.col("tag_category") == "genre_style").alias("g"), F.count("*").alias("tags"))
    best = best.select("artist_key", F.col("t.tag_normalized").alias("primary_tag"), "t.tag_category", F.col("g.genre_family").alias("primary_genre_family"), "tags")
    out = totals.join(artists.select(*PROFILE), "artist_key", "left").join(best, "artist_key", "left")
    return out.select(
        *PROFILE, "total_scrobbles", "first_listen", "last_listen", "active_years", "primary_tag", "tag_category", "primary_genre_family",
        F.coalesce("tags", F.lit(0)).cast("bigint").alias("tag_count"), F.col("tags").isNotNull().alias("tag_coverage"),
    )


def genre_evolution(events: DataFrame, weights: DataFrame) -> DataFrame:
    """Events by year, era and genre family, weighted by the artists' tags: counts of an artist and year meet the artist's
    families, not events the tags."""
    family = weights.where(F.col("tag_category") == "genre_style").groupBy("artist_key", "genre_family").agg(F.sum("tag_weight").alias("w"))
    counts = events.groupBy("artist_key", *YE).agg(F.sum("n").alias("n"))
    g = counts.join(family, "artist_key").groupBy(*YE, "genre_family").agg(F.sum(F.col("n") * F.col("w")).alias("weighted_scrobbles"), F.count_distinct("artist_key").alias("unique_artists"))
    total = counts.groupBy(*YE).agg(F.sum("n").alias("all"))
    share = F.col("weighted_scrobbles") / F.sum("weighted_scrobbles").over(Window.partitionBy(*YE))  # one row for a family
    return g.join(total, YE).withColumns({"share_of_year": share, "genre_tag_coverage": F.col("weighted_scrobbles") / F.col("all")}).drop("all")


def artist_evolution(events: DataFrame) -> DataFrame:
    """One row for an artist, year and era: rank, share, years since the first, and lifecycle."""
    g = events.groupBy("artist_key", "artist_name", *YE).agg(F.sum("n").alias("scrobbles"), F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen"))
    ranked = rank_within(g, ["year"], [F.desc("scrobbles"), F.asc("artist_name"), F.asc("artist_key"), F.asc("tracking_era")], "rank")
    total = ranked.groupBy("year").agg(F.sum("scrobbles").alias("in_year"))
    since = F.col("year") - F.min("year").over(Window.partitionBy("artist_key"))
    out = ranked.join(total, "year").withColumns({"share_of_year": F.col("scrobbles") / F.col("in_year"), "years_since_first_seen": since, "lifecycle": lifecycle("artist_key")})
    return out.select("artist_key", "artist_name", *YE, "scrobbles", "first_seen", "last_seen", "rank", "share_of_year", "years_since_first_seen", "lifecycle")


def concentration(events: DataFrame) -> DataFrame:
    counts = events.groupBy(*YE, "artist_key").agg(F.sum("n").alias("n"))
    ks = (1, 5, 10, 25, 50)
    shares = top_shares(counts, YE, "artist_key", "n", ks, [f"top_{k}_share" for k in ks])
    return shares.join(counts.groupBy(*YE).agg(hhi().alias("hhi"), F.count("*").alias("artist_count")), YE)


def _breadth(events: DataFrame) -> DataFrame:
    return events.groupBy(*YE).agg(
        F.sum("n").alias("scrobbles"), F.count_distinct("date").alias("active_days"), F.count_distinct("artist_key").alias("unique_artists"),
        F.count_distinct(F.struct("artist_name", "track_name")).alias("unique_tracks"),
    )


def diversity(events: DataFrame) -> DataFrame:
    per = lambda c: F.lit(100) * F.col(c) / F.col("scrobbles")
    return _breadth(events).drop("active_days").withColumns({"artists_per_100_scrobbles": per("unique_artists"), "tracks_per_100_scrobbles": per("unique_tracks")})


def discovery_enriched(events: DataFrame) -> DataFrame:
    """Like the plain discovery mart by artist key, with the events of artists in their first year."""
    years = events.groupBy("artist_key", "year").agg(F.sum("n").alias("n"))
    first = years.withColumn("first", F.min("year").over(Window.partitionBy("artist_key"))).where("first = year")  # a row for each year
    fresh = first.groupBy("year").agg(F.count("*").alias("new_artists"), F.sum("n").alias("new_artist_scrobbles"))
    tracks = events.groupBy("artist_name", "track_name").agg(F.min("year").alias("year")).groupBy("year").agg(F.count("*").alias("new_tracks"))
    y = _breadth(events).drop("active_days").join(fresh, "year", "left").join(tracks, "year", "left")
    y = y.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("new_artists", "new_tracks", "new_artist_scrobbles")})
    return y.withColumn("new_artist_share", F.col("new_artist_scrobbles") / F.col("scrobbles")).select(
        *YE, "scrobbles", "unique_artists", "unique_tracks", "new_artists", "new_tracks", "new_artist_scrobbles", "new_artist_share"
    )


def geography_evolution(events: DataFrame, artists: DataFrame) -> DataFrame:
    """Events by the artist's country. After the count by artist an artist is one row of a year and era, so its distinct
    count is a plain one."""
    counts = events.groupBy(*YE, "artist_key").agg(F.sum("n").alias("n")).join(artists.select("artist_key", "country"), "artist_key", "left")
    g = counts.groupBy(*YE, F.coalesce("country", F.lit("unknown")).alias("country")).agg(F.sum("n").alias("scrobbles"), F.count("*").alias("unique_artists"))
    share = F.col("scrobbles") / F.sum("scrobbles").over(Window.partitionBy(*YE))  # one row for a country
    return g.withColumns({"share_of_year": share, "country_known": F.col("country") != "unknown"})


TIME_KEYS = ["local_year", "local_month", "tracking_era", "timezone_period", "location", "timezone_name", "local_weekday", "local_hour"]


def time_patterns(local: DataFrame) -> DataFrame:
    """Prepared events with local time by hour of the local week. They are counted by name before keys are made."""
    counts = local.groupBy(*TIME_KEYS, "artist_name").agg(F.count("*").alias("n")).withColumn("artist_key", artist_key("artist_name"))
    return counts.groupBy(*TIME_KEYS).agg(F.sum("n").alias("scrobbles"), F.count_distinct("artist_key").alias("unique_artists"))


# What the mart says of a year.
NOTES = {True: "incomplete current calendar year", False: "recorded calendar year"}


def era_comparison(events: DataFrame, current_year: int) -> DataFrame:
    """One row for a year and era; the change is against the row before, which need not be the year before."""
    y = _breadth(events)
    previous = F.lag("scrobbles").over(Window.orderBy(*YE))  # one row for a year
    partial = (F.col("year") == F.max("year").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) & (F.col("year") == current_year)
    y = y.withColumns({
        "scrobbles_per_active_day": F.col("scrobbles") / F.col("active_days"), "year_over_year_scrobble_change_pct": (F.col("scrobbles") / previous - 1) * 100,
        "partial_calendar_year": partial,
    })
    return y.withColumn("comparison_note", F.when(F.col("partial_calendar_year"), NOTES[True]).otherwise(NOTES[False]))


def build_marts(events: DataFrame, prepared: DataFrame, artists: DataFrame, weights: DataFrame, periods: list[Period], current_year: int) -> dict[str, DataFrame]:
    """All enriched marts of counts from :func:`keyed`, the prepared events themselves for the hourly one, and their artists."""
    local = local_time(prepared, periods)
    return {
        "artist_profile": artist_profile(events, artists, weights), "genre_evolution": genre_evolution(events, weights), "artist_evolution": artist_evolution(events),
        "concentration": concentration(events), "diversity": diversity(events), "discovery_enriched": discovery_enriched(events),
        "geography_evolution": geography_evolution(events, artists), "time_patterns": time_patterns(local), "era_comparison": era_comparison(events, current_year),
    }


SORTED = {
    "artist_profile": ["-total_scrobbles", "source_artist_name"], "genre_evolution": [*YE, "genre_family"], "artist_evolution": ["year", "rank"], "concentration": YE,
    "diversity": YE, "discovery_enriched": YE, "geography_evolution": [*YE, "-scrobbles", "country"], "time_patterns": TIME_KEYS, "era_comparison": YE,
}


def coverage(events: DataFrame, artists: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: events before and after the join, the size of the event-tag association, and shares of events whose artist
    has a kept tag, a genre tag, a country. One pass over counts by artist."""
    counts = events.groupBy("artist_key").agg(F.sum("n").alias("n")).join(artists.select("artist_key", "country"), "artist_key", "left")
    counts = counts.select("artist_key", "n", F.when(F.col("country").isNotNull(), F.col("n")).otherwise(0).alias("placed"))
    tags = weights.groupBy("artist_key").agg(F.count("*").alias("tags"), F.count_if(F.col("tag_category") == "genre_style").alias("genres"))
    j = counts.join(tags, "artist_key", "left")
    pct = lambda c: F.coalesce(F.bround(F.lit(100) * F.sum(c) / F.sum("n"), 3), F.lit(0.0))
    return j.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.sum(F.col("n") * F.col("tags")), F.lit(0)).alias("tag_association_rows"),
        pct(F.when(F.col("tags") > 0, F.col("n")).otherwise(0)).alias("tagged_event_coverage_pct"),
        pct(F.when(F.col("genres") > 0, F.col("n")).otherwise(0)).alias("genre_family_event_coverage_pct"), pct(F.col("placed")).alias("geographic_event_coverage_pct"),
    )


def profile(events: DataFrame) -> DataFrame:
    """One row: events, artists, years and eras."""
    of = lambda era: F.coalesce(F.sum(F.when(F.col("tracking_era") == era, F.col("n"))), F.lit(0))
    return events.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events_analyzed"), F.count_distinct("artist_key").alias("artists_enriched"), F.count_distinct("year").alias("years_analyzed"),
        of(PARTIAL).alias("partial_tracking_events"), of(CONSISTENT).alias("consistent_tracking_events"),
    )
