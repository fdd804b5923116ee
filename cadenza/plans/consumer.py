"""What a dashboard asks of the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import CONSISTENT
from ..sources.publish import mart_path, read_json

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def load_mart(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A published mart, kept in memory for the questions that follow."""
    return spark.read.parquet(f"{root.rstrip('/')}/{mart_path(name)}").cache()


def tiles(spark: SparkSession, root: str) -> dict:
    """The headline numbers of the published enriched marts, from their description."""
    document = read_json(spark, f"{root.rstrip('/')}/_metadata.json")
    if not document:
        raise FileNotFoundError(f"nothing is published at {root}")
    profile, quality = document["profile"], document["quality"]
    return {"events": profile["events_analyzed"], "artists": profile["artists_enriched"], "tagged_event_coverage_pct": quality["tagged_event_coverage_pct"]}


def top_artists(profile: DataFrame, n: int = 20) -> DataFrame:
    return profile.orderBy(F.desc("total_scrobbles"), "source_artist_name", "artist_key").limit(n).select("source_artist_name", "total_scrobbles", "active_years", "primary_genre_family", "country")


def genre_families(genre: DataFrame) -> DataFrame:
    return genre.select("genre_family").where("genre_family is not null").distinct()


def genre_view(genre: DataFrame, families: list[str]) -> DataFrame:
    return genre.where(F.col("genre_family").isin(*families))


def busiest_names(evolution: DataFrame, n: int = 100) -> DataFrame:
    """The n names with the most events in one year, ties by name."""
    best = evolution.groupBy("artist_name").agg(F.max("scrobbles").alias("scrobbles"))
    return best.orderBy(F.desc("scrobbles"), "artist_name").limit(n)


def name_history(evolution: DataFrame, names: DataFrame) -> DataFrame:
    return evolution.join(names.select("artist_name"), "artist_name", "left_semi").select("year", "artist_name", "scrobbles", "share_of_year", "rank", "lifecycle")


def lifecycle_counts(evolution: DataFrame) -> DataFrame:
    return evolution.groupBy("lifecycle").agg(F.count("*").alias("artist_year_rows"))


def heatmap(patterns: DataFrame) -> DataFrame:
    """Events of the later era by local weekday and hour."""
    g = patterns.where(F.col("tracking_era") == CONSISTENT).groupBy("local_weekday", "local_hour").agg(F.sum("scrobbles").alias("scrobbles"))
    return g.withColumn("weekday", F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("local_weekday") + 1))


def by_location(patterns: DataFrame) -> DataFrame:
    return patterns.where(F.col("tracking_era") == CONSISTENT).groupBy("location").agg(F.sum("scrobbles").alias("scrobbles"))


def by_country(geography: DataFrame, n: int = 20) -> DataFrame:
    """The n known countries with the most events; artist_years adds up the artists of each year."""
    g = geography.where(F.col("country") != "unknown").groupBy("country").agg(F.sum("scrobbles").alias("scrobbles"), F.sum("unique_artists").alias("artist_years"))
    return g.orderBy(F.desc("scrobbles"), "country").limit(n)


def insights(marts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    top = lambda df, by, n, *tie: df.orderBy(F.desc(by), *tie).limit(n)
    return {
        "top_genre_years": top(marts["genre_evolution"], "weighted_scrobbles", 5, "year", "genre_family").select("year", "genre_family", "share_of_year"),
        "highest_concentration": top(marts["concentration"], "top_1_share", 3, "year", "tracking_era"),
        "highest_artist_diversity": top(marts["diversity"], "artists_per_100_scrobbles", 3, "year", "tracking_era"),
    }
