from datetime import datetime, timezone

import pytest
from cadenza.functions.calendar import era, local_time, periods_of
from cadenza.functions.text import entity_key
from cadenza.operators.joins import ContractError
from cadenza.operators.ranking import lifecycle, rank_within
from cadenza.plans import enriched, gold
from pyspark.sql import functions as F

# two plays in the last hour before the boundary, then four days in a row, two names tied for most plays, a gap, a lone day
ROWS = [
    ("p1", "Kestrel", "Harbour", "2019-12-31T23:10:00Z"), ("p2", "Kestrel", "Harbour", "2019-12-31T23:59:59Z"), ("p3", "Kestrel", "Lantern", "2020-01-01T00:00:00Z"),
    ("p4", "Moorland", "Ferry", "2020-01-02T06:30:00Z"), ("p5", "Moorland", "Ferry", "2020-01-03T06:31:00Z"), ("p6", "Aspen Row", "Ferry", "2020-01-04T18:00:00Z"),
    ("p7", "Aspen Row", "Thaw", "2020-01-04T18:04:00Z"), ("p8", "Kestrel", "Lantern", "2020-03-09T12:00:00Z"),
]
CONFIG = {
    "boundaries": {"out": {"local_datetime": "2026-01-28T00:00:00", "timezone": "Europe/Paris"}, "back": {"local_datetime": "2026-06-25T00:00:00", "timezone": "Europe/Paris"}},
    "periods": [
        {"period": "p1", "location": "Argentina", "timezone": "America/Argentina/Cordoba", "start_boundary": None, "end_boundary": "out"},
        {"period": "p2", "location": "France", "timezone": "Europe/Paris", "start_boundary": "out", "end_boundary": "back"},
        {"period": "p3", "location": "Argentina", "timezone": "America/Argentina/Cordoba", "start_boundary": "back", "end_boundary": None},
    ],
}


def events(spark, rows=ROWS):
    return spark.createDataFrame(rows, "scrobble_id string, artist_name string, track_name string, t string").withColumn("scrobbled_at", F.to_timestamp("t")).drop("t")


def test_gold(spark):
    marts = gold.build_marts(events(spark))
    years = {r.year: r for r in marts["listening_yearly"].collect()}
    assert {y: r.scrobble_count for y, r in years.items()} == {2019: 2, 2020: 6}
    assert years[2019].tracking_era == "partial_tracking"
    assert years[2020].new_artists == 2
    assert years[2020].top_artist == "Aspen Row"  # three names with two plays each
    assert sum(r.scrobble_count for r in marts["listening_daily"].collect()) == 8
    assert sorted(tuple(r)[2] for r in marts["streaks"].collect()) == [1, 4]
    assert {r.tracking_era for r in marts["listening_patterns"].collect()} == {"partial_tracking", "consistent_tracking"}
    assert gold.validate_marts(marts, 8)["silver_conservation"]
    with pytest.raises(ContractError):
        gold.validate_marts(marts, 9)
    p = gold.profile(events(spark), marts).first()
    assert (p.longest_streak, p.latest_streak, p.top_artist, p.top_track) == (4, 1, "Kestrel", "Harbour")  # of three tracks with two plays the first by name


def test_empty(spark):
    marts = gold.build_marts(events(spark, []))
    assert all(df.count() == 0 for df in marts.values())


def test_nulls_take_no_part(spark):
    rows = [*ROWS, ("n1", None, "Thaw", "2020-01-01T00:00:00Z"), ("n2", "Kestrel", "Thaw", None)]
    assert sum(r.scrobble_count for r in gold.build_marts(events(spark, rows))["listening_daily"].collect()) == 8


def test_boundary_is_a_new_year():
    with pytest.raises(ValueError):
        era("t", "2020-03-01T00:00:00+00:00")


def test_rank_within_spreads(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("v"), "id")
    got = rank_within(df, ["g"], [F.desc("v"), F.asc("id")], "r").collect()
    for g in range(3):
        rows = sorted((r for r in got if r.g == g), key=lambda r: r.r)
        assert [r.r for r in rows] == list(range(1, len(rows) + 1))
        assert [(-r.v, r.id) for r in rows] == sorted((-r.v, r.id) for r in rows)


def test_lifecycle(spark):
    df = spark.createDataFrame([("a", y) for y in (2010, 2011, 2012, 2014, 2018)] + [("a", 2018), ("b", 2000)], "k string, year int").withColumn("l", lifecycle("k"))
    got = {(r.k, r.year): r.l for r in df.collect()}
    assert got == {("a", 2010): "new", ("a", 2011): "returning", ("a", 2012): "persistent", ("a", 2014): "returning", ("a", 2018): "resurgent", ("b", 2000): "new"}


def enriched_inputs(spark):
    plays = [("e1", "Kestrel", "Harbour", "2019-05-01T07:00:00Z"), ("e2", "Kestrel", "Lantern", "2019-05-02T07:00:00Z"), ("e3", "Kestrel", "Lantern", "2019-05-02T07:04:00Z")]
    ev = events(spark, [*plays, ("e4", "Moorland", "Harbour", "2021-02-01T21:00:00Z"), ("e5", "Moorland", "Ferry", "2021-02-01T21:03:00Z")])
    key = {n: entity_key(n) for n in ("Kestrel", "Moorland")}
    rows = [
        (key["Kestrel"], "Kestrel", "id-1", "Kestrel", "Group", "NO", None, None, "resolved", "search_match", "medium"),
        (key["Moorland"], "Moorland", None, None, None, None, None, None, "ambiguous", "search_match", "low"),
    ]
    artists = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in enriched.PROFILE))
    tags = [(key["Kestrel"], "folk", 1), (key["Kestrel"], "mellow", 2), (key["Kestrel"], "drone", 4), (key["Moorland"], "jazz", 3), (key["Moorland"], "", 1), (key["Moorland"], None, 2)]
    lists = {"noise": ["check out"], "genre_family": {"folk": ["folk"], "jazz": ["jazz", "check out"], "ambient": ["drone"]}, "descriptor": ["mellow"]}
    return ev, artists, spark.createDataFrame(tags, "artist_key string, tag_normalized string, tag_rank int"), enriched.taxonomy_table(spark, lists)


def test_enriched(spark):
    ev, artists, tags, taxonomy = enriched_inputs(spark)
    joined = enriched.with_artists(ev, artists)
    assert joined.count() == 5
    with pytest.raises(ContractError):
        enriched.with_artists(ev, artists.limit(1))
    w = enriched.tag_weights(tags, taxonomy)
    assert sorted(round(r.tag_weight, 6) for r in w.collect()) == [0.142857, 0.285714, 0.571429, 1.0]  # 1, 1/2 and 1/4 of 7/4; one alone
    keyed = enriched.keyed(ev)
    enriched.check_bridge(keyed, artists)
    with pytest.raises(ContractError):
        enriched.check_bridge(keyed, artists.limit(1))
    marts = enriched.build_marts(keyed, gold.prepare(ev), artists, w, periods_of(CONFIG), 2021)
    g = {(r.year, r.genre_family): r for r in marts["genre_evolution"].collect()}
    assert round(g[2019, "folk"].weighted_scrobbles, 6) == round(3 * 4 / 7, 6)
    assert round(g[2019, "ambient"].genre_tag_coverage, 6) == round(1 / 7, 6)
    assert round(g[2019, "ambient"].share_of_year, 6) == 0.2
    assert (g[2021, "jazz"].share_of_year, g[2021, "jazz"].genre_tag_coverage) == (1.0, 1.0)
    breadth = {r.year: (r.scrobbles, r.unique_artists, r.unique_tracks) for r in marts["diversity"].collect()}
    assert breadth == {2019: (3, 1, 2), 2021: (2, 1, 2)}
    last = marts["era_comparison"].orderBy(F.desc("year")).first()
    assert last.partial_calendar_year
    assert {r.country for r in marts["geography_evolution"].collect()} == {"NO", "unknown"}
    c = enriched.coverage(keyed, artists, w).first()
    assert (c.events, c.tag_association_rows, c.tagged_event_coverage_pct, c.geographic_event_coverage_pct) == (5, 11, 100.0, 60.0)


def test_classes(spark):
    _, _, _, taxonomy = enriched_inputs(spark)
    tags = spark.createDataFrame([("drone",), ("check out",), ("unheard",), (None,)], "tag_normalized string")
    got = {r.tag_normalized: (r.tag_category, r.genre_family) for r in enriched.classified(tags, taxonomy).collect()}
    assert got == {"drone": ("genre_style", "ambient"), "check out": ("noise", None), "unheard": ("other", None), None: ("other", None)}


# Instants on both sides of the configured changes of place and of daylight saving, with local hour and weekday.
LOCAL = [
    ("2026-01-27T22:59:59Z", "America/Argentina/Cordoba", 19, 1, "2026-01-27"), ("2026-01-28T00:00:00Z", "Europe/Paris", 1, 2, "2026-01-28"),
    ("2026-02-01T12:00:00Z", "Europe/Paris", 13, 6, "2026-02-01"), ("2026-04-01T12:00:00Z", "Europe/Paris", 14, 2, "2026-04-01"),
    ("2026-06-24T21:59:59Z", "Europe/Paris", 23, 2, "2026-06-24"), ("2026-06-24T22:00:00Z", "America/Argentina/Cordoba", 19, 2, "2026-06-24"),
    ("2026-06-25T03:00:00Z", "America/Argentina/Cordoba", 0, 3, "2026-06-25"), ("2026-07-01T12:00:00Z", "America/Argentina/Cordoba", 9, 2, "2026-07-01"),
]


def test_local_time(spark):
    ev = events(spark, [(str(i), "A", "T", t) for i, (t, *_) in enumerate(LOCAL)])
    got = local_time(ev, periods_of(CONFIG)).orderBy(F.col("scrobble_id").cast("int")).collect()
    assert [(r.timezone_name, r.local_hour, r.local_weekday, str(r.local_date)) for r in got] == [x[1:] for x in LOCAL]


def test_local_time_without_period(spark):
    ev = events(spark, [("1", "A", "T", "2030-01-01T00:00:00Z"), ("2", "A", "T", None)])
    only = [p for p in periods_of(CONFIG) if p.end == datetime(2026, 1, 27, 23, tzinfo=timezone.utc)]
    assert [r.timezone_period for r in local_time(ev.where("scrobble_id = 2"), only).collect()] == [None]
    with pytest.raises(Exception, match="no configured period"):
        local_time(ev, only).collect()
