import json

import pytest
from cadenza.functions.text import canonical, redact
from cadenza.operators.joins import ContractError
from cadenza.plans import consumer, enriched, enrichment, ingest, pipeline
from cadenza.sources import config, landing
from cadenza.sources.cache import ResponseCache, cached_responses
from cadenza.sources.http import ApiError, EntityProvider, HttpError, PagedSource, RateLimiter, ShapeError, TagProvider, TransportError, backoff
from cadenza.sources.publish import read_json
from cadenza.streaming.silver_stream import stream_events

from .test_silver import track


class Answer:
    def __init__(self, body, status=200):
        self.status_code, self.body, self.text = status, body, body if isinstance(body, str) else json.dumps(body)

    def json(self):
        return json.loads(self.text)


def listing(tracks, total=1):
    return {"recenttracks": {"track": tracks, "@attr": {"user": "u", "totalPages": str(total)}}}


def source(answers, waits=None):
    seen = []

    def transport(url, params, headers, timeout):
        seen.append(params)
        a = answers[len(seen) - 1] if isinstance(answers, list) else answers(params)
        if isinstance(a, Exception):
            raise a
        return a

    s = PagedSource(transport, "http://x", "m", "u", "secret", sleep=(waits if waits is not None else []).append)
    s.seen = seen
    return s


def pages(total, start=1700000000):
    return lambda p: Answer(listing([track(name=f"t{p['page']}", uts=str(start - p["page"]))], total))


def test_retry_then_success():
    waits = []
    s = source([Answer({}, 503), Answer({"error": 8, "message": "x"}), Answer(listing([]))], waits)
    assert s.page()["recenttracks"]["track"] == []
    assert waits == [1, 2]
    assert s.seen[0]["limit"] == 200


def test_gives_up():
    waits = []
    with pytest.raises(HttpError):
        source([Answer("down", 500)] * 6, waits).page()
    assert waits == [1, 2, 4, 8, 16]
    assert backoff(3) == 4


def test_errors_do_not_tell_secrets():
    with pytest.raises(HttpError) as e:
        source([Answer({"error": 4, "message": "bad secret api_key=zzz"}, 403)]).page()
    assert "secret" not in str(e.value).replace("[redacted]", "")
    assert "zzz" not in str(e.value)
    with pytest.raises(ApiError):
        source([Answer({"error": 6, "message": "no user"})]).page()
    for odd in ({}, {"recenttracks": {"track": {}}}, "not json"):
        with pytest.raises(ShapeError):
            source([Answer(odd)]).page()
    # a transport's own message may hold the whole address
    with pytest.raises(TransportError, match="TimeoutError") as e:
        source([TimeoutError("GET http://x?api_key=secret")]).page()
    assert "secret" not in str(e.value) and e.value.__cause__ is None and e.value.__suppress_context__


def test_codes_as_text_and_listings_without_tracks():
    waits = []
    s = source([Answer({"error": "8", "message": "x"}), Answer({"recenttracks": {}})], waits)
    assert s.page() == {"recenttracks": {}} and waits == [1]
    assert [n for n, *_ in source([Answer({"recenttracks": {"@attr": {"totalPages": 3}}})]).pages()] == [1]


@pytest.mark.parametrize(("text", "want"), [
    ("GET /?user=u&api_key=abc&page=2", "GET /?user=u&api_key=[redacted]&page=2"), ('{"api_key": "a b", "page": 1}', '{"api_key": "[redacted]", "page": 1}'),
    ("API key : xyz, done", "API key : [redacted], done"), ("my-token='q w' rest", "my-token='[redacted]' rest"), ("Shared_Secret=;x=1", "Shared_Secret=[redacted];x=1"),
    ("password=", "password=[redacted]"), ("user=u page: 3", "user=u page: 3"), ("", ""),
])
def test_redaction(text, want):
    assert redact(text) == want
    assert redact(text + " s3cr3t", "s3cr3t").endswith("[redacted]")


def test_ingest_backfill_fail_resume(spark, tmp_path):
    root = str(tmp_path / "bronze")
    legacy = tmp_path / "bronze" / "ingestion_date=2020-01-01" / "run_old"
    landing.write_json(legacy / "page_0001.json", {"payload": {}})
    two = pages(2)
    bad = source(lambda p: two(p) if p["page"] == 1 else Answer("no", 404))
    with pytest.raises(HttpError):
        ingest.ingest(spark, bad, root, backfill=True)
    state = landing.runs(spark, root).first()
    assert (state.status, state.failure_type, list(state.pages_saved)) == ("failed", "HttpError", [1])
    good = source(two)
    out = ingest.ingest(spark, good, root, backfill=True, resume=True)
    assert (out["status"], out["pages_saved"], [p["page"] for p in good.seen]) == ("completed", [1, 2], [2])
    assert [r.run_id for r in landing.completed_runs(spark, root).collect()] == [out["run_id"]]
    assert ingest.since(spark, root) == 1699999999
    one = source(pages(3))
    cut = ingest.ingest(spark, one, root, max_pages=1)
    assert (cut["status"], cut["failure_type"], one.seen[0]["from"]) == ("failed", "MaxPagesLimit", 1699999999)
    assert ingest.since(spark, root) == 1699999999  # a failed run does not move it
    with pytest.raises(ValueError):
        ingest.ingest(spark, one, root, resume=True)


def test_resume_with_nothing_missing_completes(spark, tmp_path):
    root = str(tmp_path / "b")
    ingest.ingest(spark, source(pages(1)), root, backfill=True, max_pages=1)
    folder, state = landing.new_run(tmp_path / "b", "backfill")
    landing.save_page(folder, 1, listing([track()]), "s", "m")
    landing.write_json(folder / landing.STATE, state | {"status": "failed", "pages_saved": [1], "expected_pages": 1})
    s = source(pages(1))
    assert ingest.ingest(spark, s, root, backfill=True, resume=True)["status"] == "completed"
    assert s.seen == []


def land(root, run_id, tracks, status="completed", expected=1, files=(1,)):
    folder = landing.run_folder(root, run_id)
    for p in files:
        landing.save_page(folder, p, listing(tracks), "s", "m")
    landing.write_json(folder / landing.STATE, {"run_id": run_id, "mode": "backfill", "started_at": run_id, "completed_at": None, "status": status, "pages_saved": list(files), "expected_pages": expected})


def test_transform_full_noop_incremental(spark, tmp_path):
    bronze, silver = tmp_path / "bronze", str(tmp_path / "silver")
    with pytest.raises(Exception):  # noqa: B017
        pipeline.transform(spark, str(bronze), silver)
    land(bronze, "20240101T000000Z", [track(), track(), 5])
    land(bronze, "20240102T000000Z", [track(name="half")], expected=2)
    land(bronze, "20240103T000000Z", [track(name="fail")], status="failed")
    first = pipeline.transform(spark, str(bronze), silver, full=True)
    assert (first["events"], first["duplicates_removed"], first["malformed_rejected"]) == (1, 1, 1)
    assert pipeline.transform(spark, str(bronze), silver)["runs"] == 0
    land(bronze, "20240104T000000Z", [track(name="new"), track()])
    again = pipeline.transform(spark, str(bronze), silver)
    assert (again["runs"], again["events"]) == (1, 2)
    assert spark.read.parquet(f"{silver}/events").select("scrobble_id").distinct().count() == 2
    assert spark.read.parquet(f"{silver}/processed_runs").count() == 2
    about = read_json(spark, f"{silver}/_metadata.json")
    assert about["row_count"] == 2
    # a batch of another day leaves the files of the days before alone
    days = lambda: {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "silver" / "events").iterdir() if p.is_dir()}
    old = days()
    land(bronze, "20240106T000000Z", [track(name="later", uts="1709000000"), track(name="later", uts="1709000000")])
    assert pipeline.transform(spark, str(bronze), silver)["events"] == 3
    assert len(days()) == 2 and days().items() >= old.items()
    assert str(tmp_path) not in json.dumps(about)
    land(bronze, "20240105T000000Z", [track()], files=(1,))
    (landing.run_folder(bronze, "20240105T000000Z") / "page_0001.json").write_text("{", encoding="utf-8")
    with pytest.raises(ContractError):
        pipeline.transform(spark, str(bronze), silver)


def test_stream(spark, tmp_path):
    bronze = tmp_path / "bronze"
    land(bronze, "20240101T000000Z", [track()])
    for _ in range(2):
        stream_events(spark, str(bronze), str(tmp_path / "events"), str(tmp_path / "cp")).awaitTermination()
        land(bronze, "20240104T000000Z", [track(name="new"), track()])
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2


def mbids(answers):
    calls = []

    def transport(url, params, headers, timeout):
        calls.append(url)
        return answers(url, params)

    return transport, calls


def test_enrich_gold_and_marts(spark, tmp_path):
    bronze, d = tmp_path / "bronze", str(tmp_path)
    land(bronze, "20240101T000000Z", [track(), track(name="Other", uts="1700090000"), track(artist="Nobody", uts="1700190000")])
    pipeline.transform(spark, str(bronze), f"{d}/silver")
    out = pipeline.build_gold(spark, f"{d}/silver/events", f"{d}/gold")
    assert out["marts"]["listening_yearly"] == 1
    assert spark.read.parquet(f"{d}/gold/listening_patterns/streaks").count() == 2
    assert read_json(spark, f"{d}/gold/_metadata.json")["quality"]["silver_conservation"]

    def answers(url, params):
        if "query" in params:
            return Answer({"artists": [{"id": "1", "name": "Artist", "score": 90, "country": "AR", "area": {"name": "X"}, "aliases": None}] if "Artist" in params["query"] else []})
        return Answer({"toptags": {"tag": {"name": " Rock ", "count": "5"}}})

    transport, calls = mbids(answers)
    lim = RateLimiter(0)
    args = (spark, f"{d}/silver/events", f"{d}/cache", f"{d}/norm", EntityProvider(transport, "http://e", "a", lim), TagProvider(transport, "http://t", "k", lim))
    got = pipeline.enrich_artists(*args)
    assert (got["api_requests"], got["resolved_artists"], got["not_found_artists"], got["tagged_artists"]) == (4, 1, 1, 2)
    n = len(calls)
    assert pipeline.enrich_artists(*args)["evaluated_artists"] == 2
    assert len(calls) == n
    row = spark.read.parquet(f"{d}/norm/artists").where("resolution_status = 'resolved'").first()
    assert (row.country, row.area, row.resolution_confidence, row.candidate_count) == ("AR", "X", "high", 1)
    tags = spark.read.parquet(f"{d}/norm/artist_tags")
    assert {tuple(r) for r in tags.select("tag", "tag_normalized", "tag_count", "tag_rank").collect()} == {("Rock", "rock", 5, 1)}
    from .test_marts import CONFIG
    from cadenza.functions.calendar import periods_of

    taxonomy = enriched.taxonomy_table(spark, {"genre_family": {"rock": ["rock"]}})
    built = pipeline.build_enriched(spark, f"{d}/silver/events", f"{d}/norm/artists", f"{d}/norm/artist_tags", taxonomy, periods_of(CONFIG), f"{d}/enriched", current_year=2023)
    assert built["quality"]["tagged_event_coverage_pct"] == 100.0
    assert built["marts"]["artist_profile"] == 2
    again = pipeline.build_enriched(spark, f"{d}/silver/events", f"{d}/norm/artists", f"{d}/norm/artist_tags", taxonomy, periods_of(CONFIG), f"{d}/enriched", current_year=2023)
    assert again["marts"] == built["marts"]
    assert consumer.tiles(spark, f"{d}/enriched") == {"events": 3, "artists": 2, "tagged_event_coverage_pct": 100.0}
    assert consumer.load_mart(spark, f"{d}/enriched", "artist_profile").count() == 2
    with pytest.raises(FileNotFoundError):
        consumer.tiles(spark, f"{d}/nothing")


def test_checkpoints(spark, tmp_path):
    """What was answered before a crash is in the tables already, and is not asked for again."""
    bronze, d = tmp_path / "bronze", str(tmp_path)
    land(bronze, "20240101T000000Z", [track(artist=f"Name {i}", uts=str(1700000000 + i)) for i in range(5)])
    pipeline.transform(spark, str(bronze), f"{d}/silver")
    asked = []

    def transport(url, params, headers, timeout):
        asked.append(params)
        if len(asked) > 8 and len(asked) < 100:
            raise KeyboardInterrupt
        if "query" in params:
            return Answer({"artists": [{"id": params["query"], "name": params["query"][8:-1], "score": 90}]})
        return Answer({"toptags": {"tag": [{"name": "Rock", "count": 3}]}})

    args = (spark, f"{d}/silver/events", f"{d}/cache", f"{d}/norm", EntityProvider(transport, "http://e", "a", RateLimiter(0)), TagProvider(transport, "http://t", "k", RateLimiter(0)))
    with pytest.raises(KeyboardInterrupt):
        pipeline.enrich_artists(*args, every=2)
    assert spark.read.parquet(f"{d}/norm/artists").where("resolution_status = 'resolved'").count() == 4
    assert spark.read.parquet(f"{d}/norm/artist_tags").count() == 4
    asked += [None] * 100
    got = pipeline.enrich_artists(*args, every=2)
    assert (got["api_requests"], got["resolved_artists"], got["tagged_artists"]) == (2, 5, 5)


def test_cache(spark, tmp_path):
    c = ResponseCache(tmp_path)
    assert c.load("p", "artist", "x") is None
    c.store("p", "artist", "x", "success", {"a": 1})
    c.store("p", "artist", "y", "error", error="E")
    assert c.load("p", "artist", "x")["response"] == {"a": 1}
    c.path("p", "artist", "z").write_text("{", encoding="utf-8")
    assert c.load("p", "artist", "z") is None
    got = {r.request_identity: (r.status, r.response, r.error) for r in cached_responses(spark, str(tmp_path)).collect()}
    assert got == {"x": ("success", '{"a":1}', None), "y": ("error", None, "E")} or got["x"][1] == '{"a":1}'


def test_resolution(spark):
    asked = spark.createDataFrame([(k, "Name X") for k in "abcde"], "artist_key string, name string")
    rows = [
        ("a", "1", "name  x", None, 50, None), ("a", "2", "Other", None, 99, None), ("b", "1", "Name X", None, 1, None), ("b", "2", "z", "Name X", 1, None),
        ("c", "1", "z", None, 96, ["q"]), ("d", "1", "z", None, 96, None), ("d", "2", "y", None, 95, None),
    ]
    cands = spark.createDataFrame(rows, "artist_key string, id string, name string, sort_name string, score int, aliases array<string>")
    got = {r.artist_key: (r.status, r.confidence, r.candidate_id, r.candidate_count) for r in enrichment.resolve(asked, cands).collect()}
    assert got == {"a": ("resolved", "high", "1", 2), "b": ("ambiguous", "low", None, 2), "c": ("resolved", "medium", "1", 1), "d": ("ambiguous", "low", None, 2), "e": ("not_found", None, None, 0)}


def test_rate_limit():
    t, slept = [0.0], []
    lim = RateLimiter(1.0, clock=lambda: t[0], sleep=slept.append)
    lim.wait()
    t[0] = 0.1
    lim.wait()
    assert [round(x, 6) for x in slept] == [0.9]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# x\nLISTENING_API_KEY='k'\nexport LISTENING_USERNAME=u\n", encoding="utf-8")
    s = config.settings(env={}, file=tmp_path / ".env")
    assert (s.api_key, s.user, s.shared_secret) == ("k", "u", None)
    with pytest.raises(config.ConfigError):
        config.settings(env={"LISTENING_API_KEY": " "}, file=tmp_path / "none")
    assert config.enrichment(tmp_path / "none")["artist_tag_limit"] == 20


def test_cli_rejects_bad_flags():
    from cadenza.cli import main

    for bad in (["ingest", "--resume", "--endpoint", "x"], ["ingest", "--max-pages", "0", "--endpoint", "x"], []):
        with pytest.raises(SystemExit):
            main(bad)
    assert canonical("  A\t b ") == "a b"
