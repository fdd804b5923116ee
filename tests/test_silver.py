import json

import pytest
from cadenza.functions import text
from cadenza.operators import dedup, quality
from cadenza.operators.joins import ContractError, many_to_one, one_to_one, require_unique
from cadenza.plans import silver
from pyspark.sql import functions as F


def track(name="Song", artist="Artist", uts="1700000000", **more):
    return {"name": name, "mbid": "", "url": "u", "artist": {"#text": artist, "mbid": ""}, "album": {"#text": "", "mbid": ""}, "date": {"uts": uts, "#text": "x"}} | more


def page(tracks, user="user"):
    return json.dumps({"metadata": {"source": "s", "page": 1}, "payload": {"recenttracks": {"track": tracks, "@attr": {"user": user, "totalPages": "1"}}}})


def read(spark, *pages):
    rows = [(r, p, d) for r, p, d in pages]
    return silver.read_tracks(silver.flatten(spark.createDataFrame(rows, "run_id string, page int, document string")))


def test_mixed_page(spark):
    now = track() | {"@attr": {"nowplaying": "true"}, "date": None}
    t = read(spark, ("r1", 1, page([track(), track(), now, track(artist=" ")])))
    c = silver.counters(t).first()
    assert (c.raw_records, c.completed_scrobbles, c.now_playing_skipped, c.malformed_rejected) == (4, 2, 1, 1)
    out = silver.merge(None, silver.accepted(t, "s"))
    row = out.collect()
    assert len(row) == 1
    assert row[0].album_name is None
    assert row[0].artist_mbid is None
    assert silver.profile(out).first().missing_album_name_pct == 100.0
    assert quality.check_events(out) == 1


def test_reasons(spark):
    odd = [5, "x", None, track(uts="1.5"), track(uts="abc"), track(uts="-5"), track(uts="4133980800"), track(name="", artist=None), track(date="no object"), track(artist="A") | {"artist": "text"}]
    t = read(spark, ("r1", 1, page(odd, user=None)))
    got = [r.reason for r in t.orderBy("pos").collect()]
    bad = "invalid_scrobble_timestamp"
    assert got == ["record_is_not_an_object"] * 3 + [bad] * 4 + ["missing_required:user,artist_name,track_name", bad, "missing_required:user,artist_name"]
    assert silver.rejected(t).columns == ["reason", "bronze_run_id", "bronze_page", "record"]


def test_page_shapes(spark):
    docs = [("r", 1, page(track())), ("r", 2, "{}"), ("r", 3, "not json"), ("r", 4, None), ("r", 5, page([]))]
    assert read(spark, *docs).count() == 1


def test_ids_and_order(spark):
    a = read(spark, ("r2", 1, page([track(url="late")])))
    b = read(spark, ("r1", 1, page([track(url="first"), track(url="second")])), ("r1", 2, page([track(name="  SONG ", url="x")])))
    first = silver.merge(None, silver.accepted(a, "s"))
    both = silver.merge(first, silver.accepted(b, "s")).collect()
    assert len(both) == 1
    assert (both[0].bronze_run_id, both[0].lastfm_track_url) == ("r1", "first")
    assert both[0].scrobble_id == first.first().scrobble_id


def test_text_functions(spark):
    df = spark.createDataFrame([("Ｓtraße　 x",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(text.canonical_text("s")).collect()] == ["ｓtrasse x", None, ""]
    assert [r[0] for r in df.select(text.tag_normalized("s")).collect()] == ["strasse x", None, ""]
    keys = [r[0] for r in df.select(text.artist_key("s")).collect()]
    assert len(keys[0]) == 64
    assert keys[0] == text.entity_key("Straße x")
    assert text.redact("api_key=abc&x=1 password: 'p'", "zzz") == "api_key=[redacted]&x=1 password: '[redacted]'"


def test_dedup_and_membership(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 1), (None, 0)], "k string, n int")
    assert sorted(map(str, dedup.keep_first(df, ["k"], ["n"]).collect())) == sorted(map(str, df.where("n in (0, 1, 3) and not (k is null and n = 1)").collect()))
    seen = spark.createDataFrame([("a", 1), ("a", 2)], "k string, z int")
    assert dedup.present(df, seen, ["k"]).count() == 2
    assert dedup.absent(df, seen, ["k"]).count() == 3
    assert dedup.keep_first(df.limit(0), ["k"], ["n"]).count() == 0


def test_contracts(spark):
    f = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    d = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert many_to_one(f, d, ["k"], "d").count() == 3
    with pytest.raises(ContractError):
        many_to_one(f, d.where("k = 'a'"), ["k"], "d")
    with pytest.raises(ContractError):
        many_to_one(f, d.union(d), ["k"], "d")
    with pytest.raises(ContractError):
        require_unique(spark.createDataFrame([(None,)], "k string"), ["k"], "d")
    assert one_to_one(d, d.withColumnRenamed("v", "w"), ["k"], "d").count() == 2
    with pytest.raises(ContractError):
        quality.require(d, {"small": F.col("v") < 2}, "d")
