"""Schemas of the tables that are read and written."""

from __future__ import annotations

EVENTS = """scrobble_id string, user string, track_name string, artist_name string, album_name string, track_mbid string, artist_mbid string,
album_mbid string, lastfm_track_url string, scrobbled_at timestamp, scrobble_date date, scrobble_year int, scrobble_month int, scrobble_day int,
scrobble_hour int, scrobble_weekday int, source string, bronze_run_id string, bronze_page int, transformed_at timestamp"""
REJECTS = "reason string, bronze_run_id string, bronze_page int, record string"
RUNS = """run_id string, mode string, started_at string, completed_at string, status string, pages_saved array<int>, expected_pages int,
failure_type string"""
ARTISTS = """artist_key string, source_artist_name string, musicbrainz_artist_id string, canonical_name string, sort_name string, artist_type string,
country string, area string, begin_area string, begin_date string, end_date string, disambiguation string, resolution_status string,
resolution_method string, resolution_confidence string, candidate_count bigint, musicbrainz_retrieved_at string, lastfm_tags_retrieved_at string,
enriched_at string"""
TAGS = "artist_key string, tag string, tag_normalized string, tag_count bigint, tag_rank int, source string, retrieved_at string"
TAXONOMY = "tag_normalized string, tag_category string, genre_family string"
CACHE = "provider string, entity_type string, request_identity string, retrieved_at string, status string, response string, error string"


def columns(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a schema text."""
    return [tuple(x.strip().split(" ", 1)) for x in schema.replace("\n", " ").split(",")]


def conform(df, schema: str):
    """``df`` in exactly the columns of ``schema``, cast; what is missing is null, what is more is dropped."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns(schema)])
