"""The same queries in SQL for DuckDB, over views named as the tables."""

from __future__ import annotations

# Compatibility characters and what NFKC makes of them, as far as the test tables hold them.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_BLANKS = "            　"
_HALF = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
_FULL = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゙゚"
_MANY = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "K": "K", "ϲ": "ς", "…": "..."}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _nfkc(c: str) -> str:
    out = f"translate({c}, {_q(_WIDE + _BLANKS + _HALF)}, {_q(_NARROW + ' ' * len(_BLANKS) + _FULL)})"
    for a, b in _MANY.items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return f"nfc_normalize({out})"


KEY = f"sha256(regexp_replace(trim({_nfkc('artist_name')}), '\\s+', ' ', 'g'))"
LANDED = """
landed AS (SELECT *, scrobbled_at AT TIME ZONE 'UTC' AS ts FROM scrobbles WHERE "user" IS NOT NULL AND scrobbled_at IS NOT NULL AND scrobble_id IS NOT NULL),
ev AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY scrobble_id ORDER BY ts, bronze_run_id, bronze_page, row_no) AS k FROM landed) WHERE k = 1),
e AS (SELECT *, ts::DATE AS d, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, (isodow(ts) - 1)::INTEGER AS weekday, hour(ts)::INTEGER AS hour,
  CASE WHEN ts >= TIMESTAMP '2020-01-01 00:00:00' THEN 'consistent_tracking' ELSE 'partial_tracking' END AS tracking_era FROM ev)"""
_FOLD = lambda c: f"replace(replace(lower(trim(regexp_replace(translate({c}, {_q(_BLANKS)}, {_q(' ' * len(_BLANKS))}), '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"
RESOLVED = f"""
WITH r AS (SELECT artist_key, source_artist_name AS name FROM artist_profile WHERE resolution_status <> 'resolved'),
k AS (SELECT artist_key AS id, canonical_name AS cand FROM artist_profile WHERE resolution_status = 'resolved' AND canonical_name IS NOT NULL),
p AS (SELECT artist_key, id, max({_FOLD("cand")} = {_FOLD("name")}) AS exact, max(length(cand) = length(name)) AS sure
  FROM r JOIN k ON lower(split_part(name, ' ', 1)) = lower(split_part(cand, ' ', 1)) GROUP BY ALL),
c AS (SELECT artist_key, count(*) AS n, count(*) FILTER (exact) AS exacts, count(*) FILTER (sure) AS sures, min(id) FILTER (exact) AS exact_id, min(id) FILTER (sure) AS sure_id FROM p GROUP BY 1)
SELECT artist_key, CASE WHEN n IS NULL THEN 'not_found' WHEN exacts = 1 OR exacts = 0 AND sures = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN n IS NULL THEN NULL WHEN exacts = 1 THEN 'high' WHEN exacts = 0 AND sures = 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN exacts = 1 THEN exact_id WHEN exacts = 0 AND sures = 1 THEN sure_id END AS candidate_id, coalesce(n, 0)::BIGINT AS candidate_count
FROM r LEFT JOIN c USING (artist_key)"""
TS, DAY = "'%Y-%m-%d %H:%M:%S'", "'%Y-%m-%d'"
ARTISTS = (
    LANDED
    + f""",
names AS (SELECT artist_name, {KEY} AS artist_key FROM (SELECT DISTINCT artist_name FROM e)),
a AS (SELECT e.* EXCLUDE (artist_mbid), names.artist_key, p.* EXCLUDE (artist_key) FROM e JOIN names USING (artist_name) LEFT JOIN artist_profile p ON p.artist_key = names.artist_key)"""
)
WEIGHTS = """
w0 AS (SELECT artist_key, tag_normalized, min(tag_rank) AS tag_rank FROM artist_tags
  WHERE artist_key IS NOT NULL AND regexp_matches(tag_normalized, '\\S') AND tag_rank <= 5 GROUP BY ALL),
w AS (SELECT artist_key, w0.tag_normalized, tag_rank, coalesce(tag_category, 'other') AS tag_category, genre_family,
  (1.0::DOUBLE / greatest(tag_rank, 1)) / sum(1.0::DOUBLE / greatest(tag_rank, 1)) OVER (PARTITION BY artist_key) AS tag_weight
  FROM w0 LEFT JOIN tag_taxonomy t ON t.tag_normalized = w0.tag_normalized)"""
YEARLY = """
y AS (SELECT year, tracking_era, count(*) AS n, count(DISTINCT d) AS days, count(DISTINCT artist_name) AS artists, count(DISTINCT (artist_name, track_name)) AS tracks FROM e GROUP BY ALL),
fa AS (SELECT artist_name, min(year) AS first FROM e GROUP BY ALL), na AS (SELECT first AS year, count(*) AS na FROM fa GROUP BY ALL),
ft AS (SELECT artist_name, track_name, min(year) AS first FROM e GROUP BY ALL), nt AS (SELECT first AS year, count(*) AS nt FROM ft GROUP BY ALL),
ay AS (SELECT year, artist_name, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, artist_name) AS k FROM ay),
sh AS (SELECT year, max(n) AS top_n, max(artist_name) FILTER (WHERE k = 1) AS top_artist, sum(n) FILTER (WHERE k <= 1) / sum(n)::DOUBLE AS s1,
  sum(n) FILTER (WHERE k <= 5) / sum(n)::DOUBLE AS s5, sum(n) FILTER (WHERE k <= 10) / sum(n)::DOUBLE AS s10 FROM r GROUP BY ALL)"""
AE = (
    ARTISTS
    + """,
g AS (SELECT artist_key, artist_name, year, tracking_era, count(*) AS scrobbles, min(ts) AS first_ts, max(ts) AS last_ts FROM a GROUP BY ALL),
ys AS (SELECT DISTINCT artist_key, year FROM g),
lc AS (SELECT x.artist_key, x.year, max(p.year) AS prev, coalesce(bool_or(p.year = x.year - 1), false) AS p1, coalesce(bool_or(p.year = x.year - 2), false) AS p2
  FROM ys x LEFT JOIN ys p ON p.artist_key = x.artist_key AND p.year < x.year GROUP BY ALL),
ae AS (SELECT g.artist_key, artist_name, g.year, tracking_era, scrobbles, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_seen,
  (row_number() OVER (PARTITION BY g.year ORDER BY scrobbles DESC, artist_name, g.artist_key, tracking_era))::INTEGER AS rank, scrobbles / sum(scrobbles) OVER (PARTITION BY g.year)::DOUBLE AS share_of_year,
  g.year - min(g.year) OVER (PARTITION BY g.artist_key) AS years_since_first_seen,
  CASE WHEN prev IS NULL THEN 'new' WHEN prev <= g.year - 3 THEN 'resurgent' WHEN p1 AND p2 THEN 'persistent' ELSE 'returning' END AS lifecycle
  FROM g JOIN lc ON lc.artist_key = g.artist_key AND lc.year = g.year)"""
)
GENRE = (
    ARTISTS
    + ","
    + WEIGHTS
    + """,
fam AS (SELECT artist_key, genre_family, sum(tag_weight) AS w FROM w WHERE tag_category = 'genre_style' GROUP BY ALL),
cnt AS (SELECT artist_key, year, tracking_era, count(*) AS n FROM a GROUP BY ALL), tot AS (SELECT year, tracking_era, sum(n) AS all_n FROM cnt GROUP BY ALL),
gg AS (SELECT year, tracking_era, genre_family, sum(n * w) AS ws, count(DISTINCT artist_key) AS unique_artists FROM cnt JOIN fam USING (artist_key) GROUP BY ALL),
ge AS (SELECT year, tracking_era, genre_family, round(ws, 6) AS weighted_scrobbles, unique_artists, round(ws / sum(ws) OVER (PARTITION BY year, tracking_era), 6) AS share_of_year,
  round(ws / all_n, 6) AS genre_tag_coverage FROM gg JOIN tot USING (year, tracking_era))"""
)
BREADTH = """
b AS (SELECT year, tracking_era, count(*) AS scrobbles, count(DISTINCT d) AS active_days, count(DISTINCT artist_key) AS unique_artists,
  count(DISTINCT (artist_name, track_name)) AS unique_tracks FROM a GROUP BY ALL)"""
CONC = (
    ARTISTS
    + """,
c0 AS (SELECT year, tracking_era, artist_key, count(*) AS n FROM a GROUP BY ALL),
c1 AS (SELECT *, row_number() OVER (PARTITION BY year, tracking_era ORDER BY n DESC, artist_key) AS k FROM c0),
conc AS (SELECT year, tracking_era, """
    + ", ".join(f"sum(n) FILTER (WHERE k <= {k}) / sum(n)::DOUBLE AS top_{k}_share" for k in (1, 5, 10, 25, 50))
    + """, sum(n * n)::DOUBLE / (sum(n)::DOUBLE * sum(n)::DOUBLE) AS hhi, count(*) AS artist_count FROM c1 GROUP BY ALL)"""
)
DIV = (
    ARTISTS
    + ","
    + BREADTH
    + """,
div AS (SELECT year, tracking_era, scrobbles, unique_artists, unique_tracks, 100 * unique_artists / scrobbles::DOUBLE AS artists_per_100_scrobbles,
  100 * unique_tracks / scrobbles::DOUBLE AS tracks_per_100_scrobbles FROM b)"""
)
_CASE = lambda first, second, third: (
    f"CASE WHEN ts < TIMESTAMP '2019-06-01 03:00:00' THEN {first} WHEN ts < TIMESTAMP '2020-09-15 22:00:00' THEN {second} ELSE {third} END"
)
LOCAL = f"""
l0 AS (SELECT *, {_CASE("'first_home'", "'abroad'", "'second_home'")} AS timezone_period, {_CASE("'Argentina'", "'France'", "'Argentina'")} AS location,
  {_CASE("'America/Argentina/Cordoba'", "'Europe/Paris'", "'America/Argentina/Cordoba'")} AS timezone_name FROM SRC),
l AS (SELECT *, timezone(timezone_name, timezone('UTC', ts)) AS lt FROM l0)"""
PATTERNS = (
    ARTISTS
    + ","
    + LOCAL.replace("SRC", "a")
    + """,
tp AS (SELECT year(lt)::INTEGER AS local_year, month(lt)::INTEGER AS local_month, tracking_era, timezone_period, location, timezone_name, (isodow(lt) - 1)::INTEGER AS local_weekday, hour(lt)::INTEGER AS local_hour,
  count(*) AS scrobbles, count(DISTINCT artist_key) AS unique_artists FROM l GROUP BY ALL)"""
)
GEO = (
    ARTISTS
    + """,
geo AS (SELECT year, tracking_era, coalesce(country, 'unknown') AS country, count(*) AS scrobbles, count(DISTINCT artist_key) AS unique_artists FROM a GROUP BY ALL)"""
)
PROFILE = (
    ARTISTS
    + ","
    + WEIGHTS
    + f""",
best AS (SELECT artist_key, arg_min(tag_normalized, (tag_rank, tag_normalized)) AS primary_tag, arg_min(tag_category, (tag_rank, tag_normalized)) AS tag_category,
  arg_min(genre_family, (tag_rank, tag_normalized)) FILTER (WHERE tag_category = 'genre_style') AS primary_genre_family, count(*) AS tags FROM w GROUP BY ALL),
t AS (SELECT artist_key, count(*) AS total_scrobbles, strftime(min(ts), {TS}) AS first_listen, strftime(max(ts), {TS}) AS last_listen, count(DISTINCT year) AS active_years FROM a GROUP BY ALL),
ap AS (SELECT p.artist_key, p.source_artist_name, p.musicbrainz_artist_id, p.canonical_name, p.artist_type, p.country, p.area, p.begin_area, p.resolution_status, p.resolution_method,
  p.resolution_confidence, total_scrobbles, first_listen, last_listen, active_years, primary_tag, tag_category, primary_genre_family, coalesce(tags, 0) AS tag_count, tags IS NOT NULL AS tag_coverage
  FROM t JOIN artist_profile p USING (artist_key) LEFT JOIN best USING (artist_key))"""
)
SESSIONS = """
WITH s AS (SELECT lower(trim("user")) AS u, floor(epoch(scrobbled_at))::BIGINT AS s FROM scrobbles WHERE "user" IS NOT NULL AND scrobbled_at IS NOT NULL),
l AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 1800 THEN 0 ELSE 1 END AS f FROM s WINDOW w AS (PARTITION BY u ORDER BY s)),
g AS (SELECT *, sum(f) OVER (PARTITION BY u ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT u AS user_key, min(s) AS start_s, max(s) AS end_s"""
PAGES = r"""
WITH n AS (SELECT run_id, t.fullkey AS k, t.type AS ty, t.atom ->> '$' AS v FROM (SELECT run_id, payload FROM run_metadata WHERE json_valid(payload)) m, json_tree(m.payload) t WHERE t.atom IS NOT NULL),
x AS (SELECT run_id, regexp_extract(k, '^\$\.pages(\[\d+\])?', 0) AS pg, k, ty, v FROM n WHERE starts_with(k, '$.pages')),
a AS (SELECT run_id, pg, coalesce(try_cast(nullif(regexp_extract(k, '\.track\[(\d+)\]', 1), '') AS INTEGER), 0) AS track_pos, lower(trim(v)) AS artist_mbid FROM x
  WHERE ty = 'VARCHAR' AND trim(v) <> '' AND regexp_matches(k, '^\$\.pages(\[\d+\])?\.payload\.recenttracks\.track(\[\d+\])?\.(artist|credits(\[\d+\])?\.(artist|members))(\[\d+\])?\.mbid$')),
p AS (SELECT run_id, pg, coalesce(min(try_cast(v AS INTEGER)) FILTER (WHERE regexp_matches(k, '\.metadata\.page$')), min(try_cast(v AS INTEGER)) FILTER (WHERE regexp_matches(k, '\.payload\.recenttracks\."?@attr"?\.page$'))) AS page FROM x
  WHERE regexp_matches(k, '^\$\.pages(\[\d+\])?\.(metadata|payload\.recenttracks\."?@attr"?)\.page$') GROUP BY ALL)
SELECT DISTINCT run_id, page, track_pos, artist_mbid FROM a LEFT JOIN p USING (run_id, pg)"""
OK_RUN = "status = 'completed' AND expected_pages >= 1 AND list_sort(list_distinct(pages_saved)) = range(1, expected_pages + 1) AND len(pages_saved) = expected_pages"
TRACKS = f"""
SELECT artist_name, track_name, count(*) AS total_scrobbles, strftime(min(ts), {TS}) AS first_seen, strftime(max(ts), {TS}) AS last_seen, count(DISTINCT d) AS active_days,
  count(DISTINCT year) AS active_years, arg_max(year, (m, -year)) AS peak_year
FROM (SELECT *, count(*) OVER (PARTITION BY artist_name, track_name, year) AS m FROM e) GROUP BY ALL"""

SQL: dict[str, str] = {
    "listening_yearly": f"WITH {LANDED},{YEARLY} SELECT year, tracking_era, y.n AS scrobble_count, days AS active_days, artists AS unique_artists, tracks AS unique_tracks, y.n / days::DOUBLE AS average_scrobbles_per_active_day, coalesce(na, 0) AS new_artists, coalesce(nt, 0) AS new_tracks, top_artist, top_n AS top_artist_scrobbles, s1 AS top_1_artist_share, s5 AS top_5_artist_share, s10 AS top_10_artist_share, y.n / artists::DOUBLE AS scrobbles_per_unique_artist FROM y JOIN sh USING (year) LEFT JOIN na USING (year) LEFT JOIN nt USING (year)",
    "listening_daily": f"WITH {LANDED} SELECT strftime(d, {DAY}) AS date, year, month, weekday, tracking_era, count(*) AS scrobble_count, count(DISTINCT artist_name) AS unique_artists, count(DISTINCT (artist_name, track_name)) AS unique_tracks FROM e GROUP BY ALL",
    "listening_monthly": f"WITH {LANDED} SELECT year, month, printf('%04d-%02d', year, month) AS year_month, tracking_era, count(*) AS scrobble_count, count(DISTINCT d) AS active_days, count(DISTINCT artist_name) AS unique_artists, count(DISTINCT (artist_name, track_name)) AS unique_tracks, count(*) / count(DISTINCT d)::DOUBLE AS scrobbles_per_active_day FROM e GROUP BY ALL",
    "artist_stats": f"WITH {LANDED}, g AS (SELECT artist_name, year, tracking_era, count(*) AS n, count(DISTINCT track_name) AS ut, count(DISTINCT d) AS ad, min(ts) AS f, max(ts) AS l FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, artist_name, tracking_era) AS rk FROM g), t AS (SELECT artist_name, sum(n)::BIGINT AS tn, min(f) AS tf, max(l) AS tl, count(DISTINCT year) AS ay, count(*) FILTER (WHERE rk <= 10) AS t10, count(*) FILTER (WHERE rk <= 50) AS t50 FROM k GROUP BY ALL) SELECT artist_name, year, tracking_era, n AS scrobble_count, ut AS unique_tracks, ad AS active_days, strftime(f, {TS}) AS first_scrobble, strftime(l, {TS}) AS last_scrobble, rk::INTEGER AS rank_in_year, tn AS total_scrobbles, strftime(tf, {TS}) AS first_seen, strftime(tl, {TS}) AS last_seen, ay AS active_years, t10 AS years_in_top_10, t50 AS years_in_top_50, n / sum(n) OVER (PARTITION BY year)::DOUBLE AS share_of_year FROM k JOIN t USING (artist_name)",
    "track_stats": f"WITH {LANDED} {TRACKS}",
    "discovery": f"WITH {LANDED},{YEARLY}, back AS (SELECT ay.year, count(*) FILTER (WHERE first < ay.year) AS returning_artists FROM ay JOIN fa USING (artist_name) GROUP BY ALL) SELECT year, tracking_era, artists AS total_unique_artists, tracks AS total_unique_tracks, coalesce(na, 0) AS newly_observed_artists, coalesce(nt, 0) AS newly_observed_tracks, returning_artists, coalesce(na, 0) / artists::DOUBLE AS artist_discovery_rate FROM y JOIN back USING (year) LEFT JOIN na USING (year) LEFT JOIN nt USING (year)",
    "listening_patterns": f"WITH {LANDED}, g AS (SELECT tracking_era, weekday, hour, count(*) AS scrobble_count, count(DISTINCT artist_name) AS unique_artists FROM e GROUP BY ALL) SELECT *, scrobble_count / sum(scrobble_count) OVER (PARTITION BY tracking_era)::DOUBLE AS share_of_era_scrobbles FROM g",
    "streaks": f"WITH {LANDED}, x AS (SELECT DISTINCT d FROM e WHERE tracking_era = 'consistent_tracking'), i AS (SELECT d, d - row_number() OVER (ORDER BY d)::INTEGER AS g FROM x) SELECT strftime(min(d), {DAY}) AS start_date, strftime(max(d), {DAY}) AS end_date, count(*) AS days, 'consistent_tracking' AS tracking_era FROM i GROUP BY g",
    "gold_profile": f"WITH {LANDED}, tr AS ({TRACKS}), x AS (SELECT DISTINCT d FROM e WHERE tracking_era = 'consistent_tracking'), i AS (SELECT d, d - row_number() OVER (ORDER BY d)::INTEGER AS g FROM x), st AS (SELECT min(d) AS s, count(*) AS days FROM i GROUP BY g) SELECT (SELECT count(*) FROM e) AS silver_source_rows, (SELECT count(*) FROM e WHERE tracking_era = 'partial_tracking') AS partial_tracking_rows, (SELECT count(*) FROM e WHERE tracking_era = 'consistent_tracking') AS consistent_tracking_rows, (SELECT coalesce(max(days), 0) FROM st) AS longest_streak, (SELECT coalesce(arg_max(days, s), 0) FROM st) AS latest_streak, (SELECT artist_name FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_artist, (SELECT track_name FROM tr ORDER BY total_scrobbles DESC, artist_name, track_name LIMIT 1) AS top_track",
    "silver_events": f"WITH {LANDED} SELECT scrobble_id, strftime(ts, {TS}) AS scrobbled_at, bronze_run_id, bronze_page, row_no FROM ev",
    "silver_merge_incremental": f"WITH {LANDED} SELECT scrobble_id, bronze_run_id, bronze_page, row_no FROM ev",
    "unprocessed_runs": "SELECT run_id, mode, status FROM run_metadata WHERE run_id NOT IN (SELECT bronze_run_id FROM scrobbles WHERE bronze_run_id < '2020')",
    "landed_runs": "SELECT run_id, mode, status FROM run_metadata WHERE run_id IN (SELECT bronze_run_id FROM scrobbles)",
    "completed_runs": f"SELECT run_id, started_at, expected_pages FROM run_metadata WHERE {OK_RUN}",
    "latest_incomplete_backfill": "SELECT run_id, started_at, status FROM run_metadata WHERE mode = 'backfill' AND status IN ('running', 'failed') ORDER BY started_at DESC, run_id DESC LIMIT 1",
    "event_ids": 'SELECT row_no, scrobble_id AS event_id FROM scrobbles WHERE "user" IS NOT NULL AND scrobbled_at IS NOT NULL',
    "artist_keys": f"SELECT artist_name, {KEY} AS artist_key FROM (SELECT DISTINCT artist_name FROM scrobbles)",
    "artist_bridge": f"WITH {ARTISTS} SELECT resolution_status, count(*) AS n_events, count(DISTINCT artist_key) AS n_artists FROM a GROUP BY ALL",
    "silver_profile": f"WITH {LANDED} SELECT count(*) AS scrobble_count, strftime(min(ts), {TS}) AS first_scrobble, strftime(max(ts), {TS}) AS last_scrobble, count(DISTINCT artist_name) AS unique_artists, count(DISTINCT (artist_name, track_name)) AS unique_tracks, "
    + ", ".join(f"round(avg(({c} IS NULL)::INTEGER) * 100, 3) AS missing_{c}_pct" for c in ("album_name", "track_mbid", "artist_mbid"))
    + " FROM ev",
    "tag_weights": f"WITH {WEIGHTS} SELECT * FROM w",
    "artist_profile": f"WITH {PROFILE} SELECT * FROM ap",
    "genre_evolution": f"WITH {GENRE} SELECT * FROM ge",
    "artist_evolution": f"WITH {AE} SELECT * FROM ae",
    "concentration": f"WITH {CONC} SELECT * FROM conc",
    "diversity": f"WITH {DIV} SELECT * FROM div",
    "discovery_enriched": f"WITH {ARTISTS},{BREADTH}, fk AS (SELECT artist_key, min(year) AS first FROM a GROUP BY ALL), nk AS (SELECT first AS year, count(*) AS new_artists FROM fk GROUP BY ALL), nt AS (SELECT first AS year, count(*) AS new_tracks FROM (SELECT artist_name, track_name, min(year) AS first FROM a GROUP BY ALL) GROUP BY ALL), ns AS (SELECT a.year, count(*) FILTER (WHERE a.year = first) AS ns FROM a JOIN fk USING (artist_key) GROUP BY ALL) SELECT year, tracking_era, scrobbles, unique_artists, unique_tracks, coalesce(new_artists, 0) AS new_artists, coalesce(new_tracks, 0) AS new_tracks, ns AS new_artist_scrobbles, ns / scrobbles::DOUBLE AS new_artist_share FROM b LEFT JOIN nk USING (year) LEFT JOIN nt USING (year) LEFT JOIN ns USING (year)",
    "geography_evolution": f"WITH {GEO} SELECT *, scrobbles / sum(scrobbles) OVER (PARTITION BY year, tracking_era)::DOUBLE AS share_of_year, country <> 'unknown' AS country_known FROM geo",
    "time_patterns": f"WITH {PATTERNS} SELECT * FROM tp",
    "local_time": f"WITH {LANDED},{LOCAL.replace('SRC', 'ev')} SELECT scrobble_id, timezone_period, location, timezone_name, strftime(lt, {TS}) AS scrobbled_at_local, strftime(lt, {DAY}) AS local_date, year(lt)::INTEGER AS local_year, month(lt)::INTEGER AS local_month, day(lt)::INTEGER AS local_day, hour(lt)::INTEGER AS local_hour, (isodow(lt) - 1)::INTEGER AS local_weekday FROM l",
    "era_comparison": f"WITH {ARTISTS},{BREADTH}, c AS (SELECT *, scrobbles / active_days::DOUBLE AS scrobbles_per_active_day, (scrobbles / lag(scrobbles) OVER (ORDER BY year, tracking_era)::DOUBLE - 1) * 100 AS year_over_year_scrobble_change_pct, year = 2021 AND year = (SELECT max(year) FROM b) AS partial_calendar_year FROM b) SELECT *, CASE WHEN partial_calendar_year THEN 'incomplete current calendar year' ELSE 'recorded calendar year' END AS comparison_note FROM c",
    "entities": (ENTITIES := f"WITH {LANDED}, n AS (SELECT artist_name, {KEY} AS artist_key, count(*) AS n, min(ts) AS f, max(ts) AS l FROM ev GROUP BY ALL), m AS (SELECT {KEY} AS artist_key, arg_min(artist_mbid, (ts, bronze_run_id, bronze_page, scrobble_id)) AS mbid FROM ev WHERE trim(coalesce(artist_mbid, '')) <> '' GROUP BY 1), ent AS (SELECT artist_key, arg_min(artist_name, (-n, artist_name)) AS source_artist_name, sum(n)::BIGINT AS scrobble_count, strftime(min(f), {TS}) AS first_seen, strftime(max(l), {TS}) AS last_seen FROM n GROUP BY ALL) SELECT artist_key, source_artist_name, mbid AS existing_artist_mbid, scrobble_count, first_seen, last_seen FROM ent LEFT JOIN m USING (artist_key)"),
    "top_entities": f"SELECT * FROM ({ENTITIES}) ORDER BY scrobble_count DESC, source_artist_name LIMIT 50",
    "coverage": f"WITH {LANDED}, n AS (SELECT {KEY} AS artist_key, count(*) AS n FROM ev GROUP BY 1), j AS (SELECT p.artist_key, resolution_status AS st, coalesce(n, 0) AS n, (resolution_status = 'resolved')::INTEGER AS r, (p.artist_key IN (SELECT artist_key FROM artist_tags))::INTEGER AS t FROM artist_profile p LEFT JOIN n USING (artist_key)) SELECT (SELECT count(*) FROM n) AS unique_artists, count(*) AS evaluated_artists, "
    + ", ".join(f"count(*) FILTER (WHERE st = '{s}') AS {s}_artists" for s in ("resolved", "ambiguous", "not_found", "error"))
    + ", round(100 * sum(r) / count(*)::DOUBLE, 3) AS entity_coverage_pct, round(100 * sum(n * r) / sum(n)::DOUBLE, 3) AS event_coverage_pct, sum(t)::BIGINT AS tagged_artists, round(100 * sum(t) / count(*)::DOUBLE, 3) AS tag_entity_coverage_pct, round(100 * sum(n * t) / sum(n)::DOUBLE, 3) AS tag_event_coverage_pct FROM j",
    "enriched_coverage": f"WITH {ARTISTS},{WEIGHTS}, c AS (SELECT artist_key, count(*) AS n, count(country) AS p FROM a GROUP BY ALL), t AS (SELECT artist_key, count(*) AS tags, count(*) FILTER (WHERE tag_category = 'genre_style') AS gs FROM w GROUP BY ALL) SELECT sum(n)::BIGINT AS events, sum(n * tags)::BIGINT AS tag_association_rows, round(100 * sum(CASE WHEN tags > 0 THEN n ELSE 0 END) / sum(n)::DOUBLE, 3) AS tagged_event_coverage_pct, round(100 * sum(CASE WHEN gs > 0 THEN n ELSE 0 END) / sum(n)::DOUBLE, 3) AS genre_family_event_coverage_pct, round(100 * sum(p) / sum(n)::DOUBLE, 3) AS geographic_event_coverage_pct FROM c LEFT JOIN t USING (artist_key)",
    "dashboard_top_artists": f"WITH {PROFILE} SELECT source_artist_name, total_scrobbles, active_years, primary_genre_family, country FROM ap ORDER BY total_scrobbles DESC, source_artist_name, artist_key LIMIT 20",
    "dashboard_genres": f"WITH {GENRE} SELECT DISTINCT genre_family FROM ge WHERE genre_family IS NOT NULL",
    "dashboard_genre_view": f"WITH {GENRE} SELECT * FROM ge WHERE genre_family IN (SELECT DISTINCT genre_family FROM tag_taxonomy WHERE genre_family IS NOT NULL ORDER BY 1 LIMIT 6)",
    "dashboard_name_history": f"WITH {AE}, nm AS (SELECT artist_name FROM ae GROUP BY 1 ORDER BY max(scrobbles) DESC, 1 LIMIT 100) SELECT year, artist_name, scrobbles, share_of_year, rank, lifecycle FROM ae WHERE artist_name IN (SELECT artist_name FROM nm)",
    "dashboard_lifecycle": f"WITH {AE} SELECT lifecycle, count(*) AS artist_year_rows FROM ae GROUP BY ALL",
    "dashboard_heatmap": f"WITH {PATTERNS} SELECT local_weekday, local_hour, sum(scrobbles)::BIGINT AS scrobbles, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][local_weekday + 1] AS weekday FROM tp WHERE tracking_era = 'consistent_tracking' GROUP BY ALL",
    "dashboard_locations": f"WITH {PATTERNS} SELECT location, sum(scrobbles)::BIGINT AS scrobbles FROM tp WHERE tracking_era = 'consistent_tracking' GROUP BY ALL",
    "dashboard_countries": f"WITH {GEO} SELECT country, sum(scrobbles)::BIGINT AS scrobbles, sum(unique_artists)::BIGINT AS artist_years FROM geo WHERE country <> 'unknown' GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 20",
    "resolve_candidates": RESOLVED,
    "insight_genres": f"WITH {GENRE} SELECT year, genre_family, share_of_year FROM ge ORDER BY weighted_scrobbles DESC, year, genre_family LIMIT 5",
    "insight_concentration": f"WITH {CONC} SELECT * FROM conc ORDER BY top_1_share DESC, year, tracking_era LIMIT 3",
    "insight_diversity": f"WITH {DIV} SELECT * FROM div ORDER BY artists_per_100_scrobbles DESC, year, tracking_era LIMIT 3",
    "p3_found": PAGES,
    "p7_found": SESSIONS + " FROM g GROUP BY u, k",
    "p7_sessions": SESSIONS + ", count(*) AS n_events FROM g GROUP BY u, k",
}
