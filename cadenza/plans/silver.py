"""Raw pages to canonical events: flatten, validate, type, deduplicate, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import event_id, null_if_blank
from ..operators.dedup import keep_first, merge_first
from ..schemas import EVENTS, REJECTS, conform

ORDER = ["scrobbled_at", "bronze_run_id", "bronze_page", "pos"]


def flatten(pages: DataFrame) -> DataFrame:
    """(bronze_run_id, bronze_page, pos, user, track) of pages (run_id, page, document): one row for each element of the
    page's track list, as JSON text. A lone object is a list of one; a page without a list has no rows."""
    doc = F.try_parse_json("document")
    at = lambda path, kind: F.try_variant_get(F.col("v"), path, kind)
    rows = pages.withColumn("v", doc).where("v is not null")
    rows = rows.withColumn("user", null_if_blank(at('$.payload.recenttracks["@attr"].user', "string")))
    tracks = at("$.payload.recenttracks.track", "array<variant>")
    lone = at("$.payload.recenttracks.track", "variant")
    tracks = F.coalesce(tracks, F.when(lone.isNotNull(), F.array(lone)))
    rows = rows.select(F.col("run_id").alias("bronze_run_id"), F.col("page").cast("int").alias("bronze_page"), "user", F.posexplode(tracks).alias("pos", "track"))
    return rows


def _text(path: str):
    return null_if_blank(F.try_variant_get(F.col("track"), path, "string"))


def reject_reason(second: Column, required: tuple[str, ...], is_object: Column | None = None, now: Column | None = None) -> Column:
    """Why a record is no event, or null if it is one: the first of these that holds. ``second`` is null if unreadable;
    the required fields that are null or blank are listed."""
    missing = F.concat_ws(",", *[F.when(null_if_blank(c).isNull(), F.lit(c)) for c in required])
    is_object, now = F.lit(True) if is_object is None else is_object, F.lit(None).cast("string") if now is None else now
    return (
        F.when(~is_object, "record_is_not_an_object").when(now == "true", "now_playing").when(second.isNull(), "invalid_scrobble_timestamp")
        .when(missing != "", F.concat(F.lit("missing_required:"), missing))
    )


def read_tracks(flat: DataFrame) -> DataFrame:
    """Flat rows with the fields of the track and ``reason``: null for a completed event, "now_playing" for one that is
    skipped, else why it is rejected. Reasons are tried in a fixed order; missing fields are listed."""
    raw = F.to_json("track")
    second = F.expr("try_cast(trim(uts) as bigint)")
    t = flat.withColumns({
        "is_object": raw.startswith("{"), "record": raw, "now": F.try_variant_get(F.col("track"), '$["@attr"].nowplaying', "string"),
        "uts": F.try_variant_get(F.col("track"), "$.date.uts", "string"), "track_name": _text("$.name"), "artist_name": _text('$.artist["#text"]'),
        "album_name": _text('$.album["#text"]'), "track_mbid": _text("$.mbid"), "artist_mbid": _text("$.artist.mbid"), "album_mbid": _text("$.album.mbid"),
        "lastfm_track_url": _text("$.url"),
    })
    t = t.withColumn("second", second).withColumn("second", F.when(F.col("second").between(0, 4_133_980_799), F.col("second")))  # years 1970 to 2100
    return t.withColumn("reason", reject_reason(F.col("second"), ("user", "artist_name", "track_name"), F.col("is_object"), F.col("now")))


def accepted(tracks: DataFrame, source: str) -> DataFrame:
    """Events, before deduplication, with ``pos`` as the last part of the order."""
    ok = tracks.where("reason is null").withColumns({"scrobble_id": event_id("user", "artist_name", "track_name", "second"), "scrobbled_at": F.timestamp_seconds("second")})
    t = F.col("scrobbled_at")
    return ok.withColumns({
        "scrobble_date": F.to_date(t), "scrobble_year": F.year(t), "scrobble_month": F.month(t), "scrobble_day": F.dayofmonth(t), "scrobble_hour": F.hour(t),
        "scrobble_weekday": F.weekday(t), "source": F.lit(source), "transformed_at": F.current_timestamp(),
    })


def rejected(tracks: DataFrame) -> DataFrame:
    return conform(tracks.where("reason is not null and reason <> 'now_playing'"), REJECTS)


def counters(tracks: DataFrame) -> DataFrame:
    """One row: raw, completed, now-playing and malformed records."""
    return tracks.agg(
        F.count("*").alias("raw_records"), F.count_if(F.col("reason").isNull()).alias("completed_scrobbles"), F.count_if(F.col("reason") == "now_playing").alias("now_playing_skipped"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "now_playing")).alias("malformed_rejected"),
    )


def merge(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """The event table after a batch: of each id the first row by time, run, page and place; an existing row has no place."""
    if existing is not None and "pos" not in existing.columns:
        existing = existing.withColumn("pos", F.lit(-1))
    cols = [n for n, _ in map(lambda x: x.strip().split(" ", 1), EVENTS.replace("\n", " ").split(","))]
    pick = lambda d: d.select(*cols, "pos")
    return conform(merge_first(None if existing is None else pick(existing), pick(new), ["scrobble_id"], ORDER), EVENTS)


def landed(rows: DataFrame) -> DataFrame:
    """The canonical events among landed rows (scrobbles before deduplication): rows with user and time, the first of each id."""
    ok = rows.where("user is not null and scrobbled_at is not null and scrobble_id is not null")
    return keep_first(ok, ["scrobble_id"], ["scrobbled_at", "bronze_run_id", "bronze_page", "row_no"])


def profile(events: DataFrame) -> DataFrame:
    """One row: events, first and last, distinct users, artists and tracks, and the share of missing ids and albums in %."""
    pct = lambda c: F.coalesce(F.bround(F.avg(F.col(c).isNull().cast("int")) * 100, 3), F.lit(0.0)).alias(f"missing_{c}_pct")
    return events.agg(
        F.count("*").alias("scrobble_count"), F.min("scrobbled_at").alias("first_scrobble"), F.max("scrobbled_at").alias("last_scrobble"), F.count_distinct("artist_name").alias("unique_artists"),
        F.count_distinct(F.struct("artist_name", "track_name")).alias("unique_tracks"), pct("album_name"), pct("track_mbid"), pct("artist_mbid"),
    )
