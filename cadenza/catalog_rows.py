"""More queries by name, each with its SQL: operators on raw pages, cached answers and checks, which the marts do not show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_sql import KEY, LANDED, _nfkc
from .functions.text import artist_key, tag_normalized
from .operators import joins, quality
from .plans import enrichment, gold, silver
from .schemas import EVENTS, conform
from .sources import landing
from .sources.tables import load
from .storage import materialise

SOURCE = "listening"


def page_documents(runs: DataFrame) -> DataFrame:
    """(run_id, page, document) of the pages in the runs' payloads; page is the place in the payload, from 0."""
    doc = F.try_variant_get(F.try_parse_json("payload"), "$.pages", "array<variant>")
    return runs.select("run_id", F.posexplode(doc).alias("page", "d")).select("run_id", "page", F.to_json("d").alias("document"))


def _tracks(spark: SparkSession, root: str) -> DataFrame:
    return silver.read_tracks(silver.flatten(page_documents(load(spark, root, "run_metadata"))))


def payload_tracks(spark, root):
    """Records in the runs' payloads by outcome: completed, now playing, or why rejected."""
    return _tracks(spark, root).groupBy(F.coalesce("reason", F.lit("completed")).alias("outcome")).agg(F.count("*").alias("n_records"))


def payload_counters(spark, root):
    return silver.counters(_tracks(spark, root))


def payload_events(spark, root):
    """Events of the payloads before deduplication, in the columns of the event table."""
    rows = conform(silver.accepted(_tracks(spark, root), SOURCE), EVENTS)
    return rows.select("bronze_run_id", "bronze_page", "user", "artist_name", "track_name", "album_name", "artist_mbid", F.unix_timestamp("scrobbled_at").alias("second"), "scrobble_hour", "scrobble_weekday", "source")


def payload_rejects(spark, root):
    bad = silver.rejected(_tracks(spark, root))
    return bad.groupBy("bronze_run_id", "bronze_page", "reason").agg(F.count("*").alias("n_records"))


def page_shapes(spark, root):
    """Pages by whether they are page documents, as the landing reader asks before it hands pages on."""
    ok = landing.is_page("document")
    return page_documents(load(spark, root, "run_metadata")).groupBy(ok.alias("is_page")).agg(F.count("*").alias("n_pages"))


def watermark(spark, root):
    """Over pages of completed runs only: a failed run must not move it past events that were never taken in."""
    return landing.latest_second(page_documents(landing.complete(load(spark, root, "run_metadata"))))


def runs_with_files(spark, root):
    """Completed runs for each of whose pages there is a file; here a page in the payload stands for its file."""
    runs = load(spark, root, "run_metadata")
    number = F.try_variant_get(F.try_parse_json("document"), "$.metadata.page", "int")
    files = page_documents(runs).select("run_id", number.alias("page")).where("page is not null")
    return landing.with_all_files(landing.complete(runs), files, "run_id").select("run_id", "expected_pages")


def reject_reasons(spark, root):
    rows = load(spark, root, "scrobbles").withColumn("second", F.unix_timestamp("scrobbled_at"))
    reason = silver.reject_reason(F.col("second"), ("user", "artist_name", "track_name"))
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n_rows"))


def tag_forms(spark, root):
    return load(spark, root, "artist_tags").select("tag").distinct().select("tag", tag_normalized("tag").alias("tag_form"))


def tags_from_answers(spark, root):
    """The tags of each artist as a provider would answer them, read back by the tag reader: at most 20, one for each form."""
    t = load(spark, root, "artist_tags").where("artist_key is not null")
    one = F.struct(F.col("tag_rank").alias("r"), F.col("tag").alias("name"), F.col("tag_count").alias("count"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count")))
    answers = t.groupBy("artist_key").agg(F.lit("2024-01-01").alias("retrieved_at"), F.to_json(F.struct(F.struct(listed.alias("tag")).alias("toptags"))).alias("response"))
    return enrichment.tags_of(answers).select("artist_key", "tag", "tag_normalized", "tag_count", "tag_rank")


def artist_documents(spark, root):
    """Artist rows as a provider's documents, flattened again."""
    a = load(spark, root, "artist_profile")
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("name")))
    doc = F.struct(
        F.col("musicbrainz_artist_id").alias("id"), F.col("canonical_name").alias("name"), F.col("artist_type").alias("type"), F.col("country"), place("area").alias("area"), place("begin_area").alias("begin-area")
    )
    flat = enrichment.artist_fields(a.select("artist_key", F.to_json(doc).alias("response")))
    return flat.select("artist_key", "musicbrainz_artist_id", "canonical_name", "artist_type", "country", "area", "begin_area", "begin_date")


def request_identities(spark, root):
    """How each artist would be looked up: artists without country have an override, others an id of their own or a search."""
    rows = load(spark, root, "artist_profile").where("source_artist_name is not null")
    asked = rows.select("artist_key", "source_artist_name", F.when(F.col("country") != "NO", F.col("musicbrainz_artist_id")).alias("existing_artist_mbid"))
    over = rows.where("country = 'NO' and musicbrainz_artist_id is not null").select("source_artist_name", "musicbrainz_artist_id").dropDuplicates(["source_artist_name"])
    return enrichment.best_identity(asked, over).select("artist_key", "resolution_method", F.regexp_extract("request_identity", "^([a-z]+):", 1).alias("kind"))


def months_in_order(spark, root):
    """The monthly mart in its published order; the place of a row shows the order."""
    monthly = gold.listening_monthly(gold.base(gold.prepare(silver.landed(load(spark, root, "scrobbles")))))
    ordered = gold.in_order(monthly, gold.SORTED["listening_monthly"]).coalesce(1)  # a row for each month and era
    return ordered.select(F.monotonically_increasing_id().alias("place"), "year_month", "tracking_era", "scrobble_count")


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} bigint" for k in values))


def checked_events(spark, root):
    """Events that pass the checks of the canonical table and are conserved by the daily and yearly marts."""
    ev = materialise(silver.landed(load(spark, root, "scrobbles")).where("artist_name is not null and track_name is not null"), "events")
    n = quality.check_events(ev)
    b = materialise(gold.base(gold.prepare(ev)), "base")
    quality.conserved(n, {"daily": (gold.listening_daily(b), "scrobble_count"), "yearly": (gold.listening_yearly(b), "scrobble_count")})
    return _one(spark, n_events=n)


def broken_rules(spark, root):
    """Rows of an hourly table that break each rule of the marts; hours are moved by three, so some leave their range."""
    moved = gold.prepare(silver.landed(load(spark, root, "scrobbles"))).withColumn("hour", F.col("hour") + 3)
    return _one(spark, **{k.replace(" ", "_"): v for k, v in quality.violations(moved.select("month", "weekday", "hour", "tracking_era"), quality.mart_rules(moved.select("month", "weekday", "hour", "tracking_era"))).items()})


def events_with_country(spark, root):
    """Every event with its artist's country; raises if an artist stands twice or an event has none."""
    ev = gold.prepare(silver.landed(load(spark, root, "scrobbles"))).select("scrobble_id", artist_key("artist_name").alias("artist_key"))
    artists = load(spark, root, "artist_profile").select("artist_key", "country", "resolution_status")
    return joins.many_to_one(materialise(ev, "events"), artists, ["artist_key"], "artists", True).select("scrobble_id", "country", "resolution_status")


def artists_one_to_one(spark, root):
    """Two tables of artists with one row for each key on both sides."""
    a = load(spark, root, "artist_profile")
    return joins.one_to_one(a.select("artist_key", "country"), a.select("artist_key", "resolution_status"), ["artist_key"], "artists")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        payload_tracks, payload_counters, payload_events, payload_rejects, page_shapes, watermark, runs_with_files, reject_reasons, tag_forms, tags_from_answers,
        artist_documents, request_identities, months_in_order, checked_events, broken_rules, events_with_country, artists_one_to_one,
    )
}

_SCALAR = "('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN')"
_TRIM = lambda x: f"nullif(regexp_replace({x}, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g'), '')"
_AT = lambda d, path: f"CASE WHEN json_type({d}, '{path}') IN {_SCALAR} THEN json_extract_string({d}, '{path}') END"
PAGES = """
l AS (SELECT run_id, status, pages_saved, expected_pages, CASE WHEN json_valid(payload) AND json_type(payload, '$.pages') = 'ARRAY' THEN json_extract(payload, '$.pages[*]') ELSE [] END AS l FROM run_metadata),
p AS (SELECT run_id, status, pages_saved, expected_pages, unnest(l) AS d, unnest(range(len(l)))::INTEGER AS page FROM l)"""
TRACKS = PAGES + f""",
t0 AS (SELECT p.*, {_TRIM(_AT("d", '$.payload.recenttracks."@attr".user'))} AS u, CASE WHEN json_type(d, '$.payload.recenttracks.track') = 'ARRAY' THEN json_extract(d, '$.payload.recenttracks.track[*]')
  WHEN json_type(d, '$.payload.recenttracks.track') IS NULL THEN [] ELSE [json_extract(d, '$.payload.recenttracks.track')] END AS ts FROM p),
t1 AS (SELECT * EXCLUDE (ts), unnest(ts) AS t FROM t0),
t2 AS (SELECT *, json_type(t) = 'OBJECT' AS is_object, {_AT("t", '$."@attr".nowplaying')} AS now, trim({_AT("t", '$.date.uts')}, ' ') AS uts, {_TRIM(_AT("t", '$.name'))} AS track_name,
  {_TRIM(_AT("t", '$.artist."#text"'))} AS artist_name, {_TRIM(_AT("t", '$.album."#text"'))} AS album_name, {_TRIM(_AT("t", '$.artist.mbid'))} AS artist_mbid FROM t1),
t3 AS (SELECT *, CASE WHEN regexp_matches(uts, '^[+-]?[0-9]{{1,18}}$') AND uts::BIGINT BETWEEN 0 AND 4133980799 THEN uts::BIGINT END AS s,
  concat_ws(',', CASE WHEN u IS NULL THEN 'user' END, CASE WHEN artist_name IS NULL THEN 'artist_name' END, CASE WHEN track_name IS NULL THEN 'track_name' END) AS m FROM t2),
t AS (SELECT *, CASE WHEN NOT is_object THEN 'record_is_not_an_object' WHEN now = 'true' THEN 'now_playing' WHEN s IS NULL THEN 'invalid_scrobble_timestamp' WHEN m <> '' THEN 'missing_required:' || m END AS reason FROM t3)"""
_OK_RUN = "status = 'completed' AND expected_pages >= 1 AND list_sort(pages_saved) = range(1, expected_pages + 1)"
_TAG = f"replace(trim(regexp_replace(lower({_nfkc('tag')}), '\\s+', ' ', 'g')), 'ß', 'ss')"
SQL: dict[str, str] = {
    "payload_tracks": f"WITH {TRACKS} SELECT coalesce(reason, 'completed') AS outcome, count(*) AS n_records FROM t GROUP BY ALL",
    "payload_counters": f"WITH {TRACKS} SELECT count(*) AS raw_records, count(*) FILTER (reason IS NULL) AS completed_scrobbles, count(*) FILTER (reason = 'now_playing') AS now_playing_skipped, count(*) FILTER (reason <> 'now_playing') AS malformed_rejected FROM t",
    "payload_events": f"""WITH {TRACKS} SELECT run_id AS bronze_run_id, page AS bronze_page, u AS "user", artist_name, track_name, album_name, artist_mbid, s AS second,
  hour(make_timestamp(s * 1000000))::INTEGER AS scrobble_hour, (isodow(make_timestamp(s * 1000000)) - 1)::INTEGER AS scrobble_weekday, '{SOURCE}' AS source FROM t WHERE reason IS NULL""",
    "payload_rejects": f"WITH {TRACKS} SELECT run_id AS bronze_run_id, page AS bronze_page, reason, count(*) AS n_records FROM t WHERE reason <> 'now_playing' GROUP BY ALL",
    "page_shapes": f"WITH {PAGES} SELECT coalesce(json_type(d, '$.payload.recenttracks') = 'OBJECT', false) AS is_page, count(*) AS n_pages FROM p GROUP BY ALL",
    "watermark": f"WITH {TRACKS} SELECT max(s) AS watermark FROM t WHERE {_OK_RUN} AND coalesce(now, '') <> 'true'",
    "runs_with_files": f"""WITH {PAGES}, f AS (SELECT run_id, list_sort(list_distinct(list(try_cast({_AT("d", '$.metadata.page')} AS INTEGER)))) AS files FROM p WHERE try_cast({_AT("d", '$.metadata.page')} AS INTEGER) IS NOT NULL GROUP BY 1)
SELECT run_id, expected_pages FROM run_metadata JOIN f USING (run_id) WHERE {_OK_RUN} AND files = range(1, expected_pages + 1)""",
    "reject_reasons": "SELECT CASE WHEN scrobbled_at IS NULL THEN 'invalid_scrobble_timestamp' WHEN m <> '' THEN 'missing_required:' || m ELSE 'accepted' END AS reason, count(*) AS n_rows FROM (SELECT *, concat_ws(',', CASE WHEN trim(coalesce(\"user\", '')) = '' THEN 'user' END, CASE WHEN trim(coalesce(artist_name, '')) = '' THEN 'artist_name' END, CASE WHEN trim(coalesce(track_name, '')) = '' THEN 'track_name' END) AS m FROM scrobbles) GROUP BY ALL",
    "tag_forms": f"SELECT tag, {_TAG} AS tag_form FROM (SELECT DISTINCT tag FROM artist_tags)",
    "tags_from_answers": f"""WITH o AS (SELECT artist_key, tag, tag_count, row_number() OVER (PARTITION BY artist_key ORDER BY tag_rank, tag, tag_count) AS r FROM artist_tags WHERE artist_key IS NOT NULL),
k AS (SELECT artist_key, {_TRIM("tag")} AS tag, {_TAG} AS form, greatest(tag_count, 0) AS n, r FROM o WHERE r <= 20),
d AS (SELECT *, row_number() OVER (PARTITION BY artist_key, form ORDER BY r) AS k FROM k WHERE tag IS NOT NULL)
SELECT artist_key, tag, form AS tag_normalized, n AS tag_count, r::INTEGER AS tag_rank FROM d WHERE k = 1""",
    "artist_documents": "SELECT artist_key, musicbrainz_artist_id, canonical_name, artist_type, country, area, begin_area, NULL::VARCHAR AS begin_date FROM artist_profile",
    "request_identities": """WITH o AS (SELECT DISTINCT source_artist_name AS n FROM artist_profile WHERE country = 'NO' AND musicbrainz_artist_id IS NOT NULL),
j AS (SELECT artist_key, n IS NOT NULL AS over, country <> 'NO' AND musicbrainz_artist_id IS NOT NULL AS own FROM artist_profile LEFT JOIN o ON n = source_artist_name WHERE source_artist_name IS NOT NULL)
SELECT artist_key, CASE WHEN over THEN 'manual_override' WHEN own THEN 'existing_mbid' ELSE 'search_match' END AS resolution_method, CASE WHEN over OR own THEN 'mbid' ELSE 'name' END AS kind FROM j""",
    "months_in_order": f"""WITH {LANDED}, g AS (SELECT strftime(d, '%Y-%m') AS year_month, tracking_era, count(*) AS scrobble_count FROM e WHERE artist_name IS NOT NULL AND track_name IS NOT NULL GROUP BY ALL)
SELECT row_number() OVER (ORDER BY year_month, tracking_era) - 1 AS place, * FROM g""",
    "checked_events": f"WITH {LANDED} SELECT count(*) AS n_events FROM e WHERE artist_name IS NOT NULL AND track_name IS NOT NULL",
    "broken_rules": f"WITH {LANDED} SELECT 0::BIGINT AS known_era, 0::BIGINT AS month_in_range, 0::BIGINT AS weekday_in_range, count(*) FILTER (hour > 20) AS hour_in_range FROM e WHERE artist_name IS NOT NULL AND track_name IS NOT NULL",
    "events_with_country": f"WITH {LANDED} SELECT scrobble_id, country, resolution_status FROM (SELECT scrobble_id, {KEY} AS artist_key FROM e WHERE artist_name IS NOT NULL AND track_name IS NOT NULL) LEFT JOIN artist_profile USING (artist_key)",
    "artists_one_to_one": "SELECT artist_key, country, resolution_status FROM artist_profile",
}


def _elements(x: str) -> str:
    """A value as a list: an array's elements, a lone value alone, nothing for an absent one."""
    return f"CASE WHEN {x} IS NULL THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


def _step(name: str, before: str, key: str) -> str:
    """The nodes below a member, with the ordinals of the member and of the element at the end of their labels."""
    value = f"json_extract(d, '$.\"{key}\"')"
    return f"""{name} AS (SELECT run_id, list_concat(label, [k, i]) AS label, d FROM (SELECT run_id, label, list_position(json_keys(d), '{key}')::INTEGER - 1 AS k,
  unnest({_elements(value)}) AS d, unnest(range(len({_elements(value)})))::INTEGER AS i FROM {before} WHERE json_type(d) = 'OBJECT' AND {value} IS NOT NULL))"""


def _first(*keys: str) -> str:
    """The first scalar below a chain of members, as text."""
    found = "[d]"
    for n, key in enumerate(keys):
        value = f"json_extract(x{n}, '$.\"{key}\"')"
        found = f"flatten(list_transform({found}, lambda x{n}: {_elements(value)}))"
    return f"json_extract_string(list_filter({found}, lambda y: json_type(y) IN {_SCALAR})[1], '$')"


def _whole(text: str) -> str:
    return f"CASE WHEN regexp_matches(trim({text}, ' '), '^[+-]?[0-9]{{1,9}}$') THEN trim({text}, ' ')::INTEGER END"


_NODES = ",\n".join([
    "n0 AS (SELECT run_id, payload::JSON AS d, []::INTEGER[] AS label FROM run_metadata WHERE json_valid(payload))", _step("pg", "n0", "pages"), _step("pl", "pg", "payload"),
    _step("rt", "pl", "recenttracks"), _step("tr", "rt", "track"), _step("ra", "tr", "artist"), _step("cr", "tr", "credits"), _step("ca", "cr", "artist"), _step("cm", "cr", "members"),
])
_REF = lambda t, kind: f"SELECT run_id, label, label[:8] AS track_label, '{kind}' AS kind, coalesce({_first('#text')}, {_first('name')}) AS name, {_first('mbid')} AS mbid FROM {t} WHERE json_type(d) = 'OBJECT'"
SQL |= {
    "p3_pages": f"""WITH {_NODES} SELECT run_id, label, []::INTEGER[] AS parent_label, coalesce({_whole(_first('metadata', 'page'))}, {_whole(_first('payload', 'recenttracks', '@attr', 'page'))}) AS page,
  {_first('payload', 'recenttracks', '@attr', 'user')} AS "user", {_whole(_first('payload', 'recenttracks', '@attr', 'totalPages'))} AS total_pages FROM pg WHERE json_type(d) = 'OBJECT'""",
    "p3_tracks": f"""WITH {_NODES} SELECT run_id, label, label[:2] AS page_label, label[8] AS track_pos, {_first('name')} AS name, {_first('mbid')} AS mbid, {_first('url')} AS url, {_first('date', 'uts')} AS uts,
  {_first('@attr', 'nowplaying')} AS now_playing FROM tr WHERE json_type(d) = 'OBJECT'""",
    "p3_references": f"WITH {_NODES} " + " UNION ALL ".join(_REF(t, k) for t, k in (("ra", "artist"), ("ca", "credit_artist"), ("cm", "credit_member"))),
}
