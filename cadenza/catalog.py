"""Queries by name. Each reads the tables under a folder; times come out as text so that any engine's result compares."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalog_rows, catalog_sql
from .functions.calendar import Period, local_time
from .functions.text import artist_key, canonical_text, event_id
from .operators import dedup
from .operators.sessions import sessions
from .plans import consumer, enriched, enrichment, gold, pages, silver
from .sources.landing import complete, latest_incomplete
from .sources.tables import load
from .storage import materialise

#: Three stretches inside the test tables' time, two places.
_EDGES = [datetime(2019, 6, 1, 3, tzinfo=timezone.utc), datetime(2020, 9, 15, 22, tzinfo=timezone.utc)]
PERIODS = [
    Period("first_home", "Argentina", "America/Argentina/Cordoba", None, _EDGES[0]),
    Period("abroad", "France", "Europe/Paris", *_EDGES),
    Period("second_home", "Argentina", "America/Argentina/Cordoba", _EDGES[1], None),
]
CURRENT_YEAR = 2021
SPLIT_RUN = "2020"  # runs before it count as processed


def plain(df: DataFrame) -> DataFrame:
    """Times and dates as text."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(out) if out else df


def events(spark: SparkSession, root: str) -> DataFrame:
    return silver.landed(load(spark, root, "scrobbles"))


def _base(spark: SparkSession, root: str) -> DataFrame:
    """The shared aggregate, written once: a mart reads it in several branches."""
    return materialise(gold.base(gold.prepare(events(spark, root))), "base")


def _joined(spark: SparkSession, root: str) -> DataFrame:
    return enriched.with_artists(materialise(events(spark, root).select("artist_name", "track_name", "scrobbled_at"), "events"), load(spark, root, "artist_profile"))


def _keyed(spark: SparkSession, root: str) -> DataFrame:
    return enriched.keyed(events(spark, root))


def _written(spark: SparkSession, root: str) -> DataFrame:
    """Keyed counts, written once for a mart that reads them in several branches."""
    return materialise(_keyed(spark, root), "keyed")


def _artists(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "artist_profile")


def _weights(spark: SparkSession, root: str) -> DataFrame:
    return enriched.tag_weights(load(spark, root, "artist_tags"), load(spark, root, "tag_taxonomy"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of fractions depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def silver_events(spark, root):
    return plain(events(spark, root).select("scrobble_id", "scrobbled_at", "bronze_run_id", "bronze_page", "row_no"))


def silver_merge_incremental(spark, root):
    rows = load(spark, root, "scrobbles").where("user is not null and scrobbled_at is not null")
    order = ["scrobbled_at", "bronze_run_id", "bronze_page", "row_no"]
    old = dedup.keep_first(rows.where(F.col("bronze_run_id") < SPLIT_RUN), ["scrobble_id"], order)
    merged = dedup.merge_first(old, rows.where(F.col("bronze_run_id") >= SPLIT_RUN), ["scrobble_id"], order)
    return plain(merged.select("scrobble_id", "bronze_run_id", "bronze_page", "row_no"))


def unprocessed_runs(spark, root):
    done = load(spark, root, "scrobbles").where(F.col("bronze_run_id") < SPLIT_RUN).select(F.col("bronze_run_id").alias("run_id"))
    return dedup.absent(load(spark, root, "run_metadata").select("run_id", "mode", "status"), done.distinct(), ["run_id"])


def landed_runs(spark, root):
    seen = load(spark, root, "scrobbles").select(F.col("bronze_run_id").alias("run_id")).distinct()
    return dedup.present(load(spark, root, "run_metadata").select("run_id", "mode", "status"), seen, ["run_id"])


def completed_runs(spark, root):
    return complete(load(spark, root, "run_metadata")).select("run_id", "started_at", "expected_pages")


def latest_incomplete_backfill(spark, root):
    return latest_incomplete(load(spark, root, "run_metadata")).select("run_id", "started_at", "status")


def event_ids(spark, root):
    rows = load(spark, root, "scrobbles").where("user is not null and scrobbled_at is not null")
    return rows.select("row_no", event_id("user", "artist_name", "track_name", F.unix_timestamp("scrobbled_at")).alias("event_id"))


def artist_keys(spark, root):
    return load(spark, root, "scrobbles").select("artist_name").distinct().select("artist_name", artist_key("artist_name").alias("artist_key"))


def artist_bridge(spark, root):
    j = _joined(spark, root)
    return j.groupBy("resolution_status").agg(F.count("*").alias("n_events"), F.count_distinct("artist_key").alias("n_artists"))


def silver_profile(spark, root):
    return plain(silver.profile(events(spark, root)))


def listening_patterns(spark, root):
    return gold.listening_patterns(gold.prepare(events(spark, root)))


def gold_profile(spark, root):
    ev = materialise(events(spark, root).select("artist_name", "track_name", "scrobbled_at"), "events")
    return gold.profile(ev, gold.build_marts(ev))


def tag_weights(spark, root):
    return _weights(spark, root)


def artist_profile(spark, root):
    return plain(enriched.artist_profile(_keyed(spark, root), _artists(spark, root), _weights(spark, root)))


def genre_evolution(spark, root):
    return _rounded(enriched.genre_evolution(_keyed(spark, root), _weights(spark, root)), "weighted_scrobbles", "share_of_year", "genre_tag_coverage")


def _evolution(spark, root):
    return enriched.artist_evolution(_keyed(spark, root))


def artist_evolution(spark, root):
    return plain(_evolution(spark, root))


def era_comparison(spark, root):
    return enriched.era_comparison(_keyed(spark, root), CURRENT_YEAR)


def local_times(spark, root):
    cols = ["scrobble_id", "timezone_period", "location", "timezone_name", "scrobbled_at_local", "local_date", "local_year", "local_month", "local_day", "local_hour", "local_weekday"]
    return plain(local_time(events(spark, root), PERIODS).select(*cols))


def _time_patterns(spark, root):
    return enriched.time_patterns(local_time(gold.prepare(events(spark, root)), PERIODS))


def entities(spark, root):
    return plain(enrichment.entities(events(spark, root)))


def top_entities(spark, root):
    return plain(enrichment.by_volume(enrichment.entities(events(spark, root)), 50))


def coverage(spark, root):
    return enrichment.coverage(events(spark, root), load(spark, root, "artist_profile"), load(spark, root, "artist_tags"))


def enriched_coverage(spark, root):
    return enriched.coverage(_keyed(spark, root), _artists(spark, root), _weights(spark, root))


def resolve_candidates(spark, root):
    """Each unresolved artist's candidates are the resolved artists whose canonical name has the same first word; the score is
    made of the lengths of both names, so that every branch of the resolution occurs. Candidates are counted by word, by word
    and spelling, and by word and length before they meet the artists: a word in many names makes no pairs."""
    a = load(spark, root, "artist_profile")
    word = lambda c: F.lower(F.substring_index(c, " ", 1))
    name = F.col("source_artist_name")
    asked = a.where("resolution_status <> 'resolved'").select("artist_key", word(name).alias("w"), canonical_text(name).alias("spelling"), F.length(name).alias("size"))
    known = a.where("resolution_status = 'resolved' and canonical_name is not null")
    known = known.select(F.col("artist_key").alias("id"), word(F.col("canonical_name")).alias("w"), canonical_text("canonical_name").alias("spelling"), F.length("canonical_name").alias("size"))
    counts = lambda by, n, *least: known.groupBy(*by).agg(F.count_distinct("id").alias(n), *[F.min("id").alias(c) for c in least])
    met = asked.join(counts(["w"], "candidate_count"), "w")
    met = met.join(counts(["w", "spelling"], "exacts", "exact_id"), ["w", "spelling"], "left").join(counts(["w", "size"], "sures", "sure_id"), ["w", "size"], "left")
    return enrichment.decided(asked, met.select("artist_key", "candidate_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("exacts", "sures")], "exact_id", "sure_id"))


def dashboard_top_artists(spark, root):
    return consumer.top_artists(enriched.artist_profile(_keyed(spark, root), _artists(spark, root), _weights(spark, root)))


def dashboard_genres(spark, root):
    return consumer.genre_families(enriched.genre_evolution(_keyed(spark, root), _weights(spark, root)))


def dashboard_genre_view(spark, root):
    families = [r[0] for r in load(spark, root, "tag_taxonomy").select("genre_family").where("genre_family is not null").distinct().orderBy("genre_family").limit(6).collect()]
    return consumer.genre_view(genre_evolution(spark, root), families)


def dashboard_name_history(spark, root):
    e = _evolution(spark, root)
    return consumer.name_history(e, consumer.busiest_names(e))


def dashboard_lifecycle(spark, root):
    return consumer.lifecycle_counts(_evolution(spark, root))


def dashboard_heatmap(spark, root):
    return consumer.heatmap(_time_patterns(spark, root))


def dashboard_locations(spark, root):
    return consumer.by_location(_time_patterns(spark, root))


def _geography(spark, root):
    return enriched.geography_evolution(_keyed(spark, root), _artists(spark, root))


def dashboard_countries(spark, root):
    return consumer.by_country(_geography(spark, root))


def _insight(name: str):
    def run(spark, root):
        ev = _keyed(spark, root)
        marts = {"genre_evolution": _rounded(enriched.genre_evolution(ev, _weights(spark, root)), "weighted_scrobbles", "share_of_year"), "concentration": enriched.concentration(ev), "diversity": enriched.diversity(ev)}
        return consumer.insights(marts)[name]

    return run


def p7_sessions(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "scrobbles")
    user = F.lower(F.regexp_replace("user", r"(?U)^\s+|\s+$", ""))
    return sessions(rows, user, F.unix_timestamp("scrobbled_at"), 1800).withColumnRenamed("entity", "user_key")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_sessions(spark, root).select("user_key", "start_s", "end_s")


def _runs(builder):
    return lambda spark, root: builder(load(spark, root, "run_metadata"))


def _from_base(builder):
    return lambda spark, root: plain(builder(_base(spark, root)))


def _from_keyed(builder, read=_keyed):
    return lambda spark, root: builder(read(spark, root))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "listening_yearly": _from_base(gold.listening_yearly), "listening_daily": _from_base(gold.listening_daily), "listening_monthly": _from_base(gold.listening_monthly),
    "artist_stats": _from_base(gold.artist_stats), "track_stats": _from_base(gold.track_stats), "discovery": _from_base(gold.discovery),
    "listening_patterns": listening_patterns, "streaks": _from_base(gold.listening_streaks), "gold_profile": gold_profile,
    "silver_events": silver_events, "silver_merge_incremental": silver_merge_incremental, "unprocessed_runs": unprocessed_runs, "landed_runs": landed_runs,
    "completed_runs": completed_runs, "latest_incomplete_backfill": latest_incomplete_backfill, "event_ids": event_ids, "artist_keys": artist_keys, "artist_bridge": artist_bridge, "silver_profile": silver_profile,
    "tag_weights": tag_weights, "artist_profile": artist_profile, "genre_evolution": genre_evolution, "artist_evolution": artist_evolution,
    "concentration": _from_keyed(enriched.concentration), "diversity": _from_keyed(enriched.diversity), "discovery_enriched": _from_keyed(enriched.discovery_enriched, _written),
    "geography_evolution": _geography, "time_patterns": _time_patterns, "local_time": local_times, "era_comparison": era_comparison, "entities": entities,
    "top_entities": top_entities, "coverage": coverage, "enriched_coverage": enriched_coverage, "resolve_candidates": resolve_candidates,
    "dashboard_top_artists": dashboard_top_artists, "dashboard_genres": dashboard_genres, "dashboard_genre_view": dashboard_genre_view,
    "dashboard_name_history": dashboard_name_history, "dashboard_lifecycle": dashboard_lifecycle, "dashboard_heatmap": dashboard_heatmap,
    "dashboard_locations": dashboard_locations, "dashboard_countries": dashboard_countries,
    "insight_genres": _insight("top_genre_years"), "insight_concentration": _insight("highest_concentration"), "insight_diversity": _insight("highest_artist_diversity"),
    "p3_found": _runs(pages.artist_ids), "p3_pages": _runs(pages.page_table), "p3_tracks": _runs(pages.track_table), "p3_references": _runs(pages.reference_table),
    "p7_found": p7_found, "p7_sessions": p7_sessions, **catalog_rows.QUERIES,
}
SQL: dict[str, str] = catalog_sql.SQL | catalog_rows.SQL
