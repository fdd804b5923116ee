"""The steps end to end: landing -> events -> marts -> enrichment -> enriched marts. Actions happen only here."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import Period
from ..functions.text import canonical
from ..operators import dedup, quality
from ..operators.joins import ContractError
from ..schemas import ARTISTS, EVENTS, TAGS, conform
from ..sources import landing
from ..sources.cache import ResponseCache, cached_responses
from ..sources.http import EntityProvider, SourceError, TagProvider
from ..sources.publish import publish, read_json, replace_rejects, replace_table, write_json
from ..sources.tables import load_or_none
from ..storage import discard, materialise
from . import enriched, enrichment, gold, silver


def load_events(spark: SparkSession, path: str) -> DataFrame | None:
    """The event table, or None where there is none yet."""
    return load_or_none(spark, path, EVENTS)


def merge_events(spark: SparkSession, path: str, new: DataFrame, full: bool = False) -> int:
    """Merge accepted events into the table at ``path``, a folder for each day. An id stands for an instant, so its rows are all
    of one day: only the days of ``new`` are read, checked and written. Returns the rows of these days."""
    existing = None if full else load_events(spark, path)
    if existing is not None:
        days = [r[0] for r in new.select("scrobble_date").distinct().collect()]  # as many as the calendar has
        existing = existing.where(F.col("scrobble_date").isin(days))
    merged = materialise(silver.merge(existing, new), "merged")
    quality.check_events(merged)
    rows = replace_table(merged, path, "scrobble_date", only_parts=existing is not None)
    discard(merged)
    return rows


def transform(spark: SparkSession, landing_root: str, root: str, full: bool = False, source: str = "provider") -> dict:
    """New completed runs into the event table at ``root``/events; with ``full``, all runs anew. Events are published first,
    then the rejects of these runs, then the list of processed runs and the description. Without new runs nothing changes."""
    runs = landing.completed_runs(spark, landing_root)
    existing = None if full else load_events(spark, f"{root}/events")
    done = None if full else load_or_none(spark, f"{root}/processed_runs")
    todo = runs if done is None else dedup.absent(runs, done, ["run_id"])
    if todo.isEmpty():
        if existing is None:
            raise ContractError("there is no completed run")
        return {"runs": 0, "events": quality.check_events(existing), **silver.profile(existing).first().asDict()}
    tracks = materialise(silver.read_tracks(silver.flatten(landing.pages_of(spark, landing_root, todo))).drop("track"), "tracks")
    counts = silver.counters(tracks).first().asDict()
    before = 0 if existing is None else existing.count()
    ids = materialise(todo.select("run_id"), "ids")
    new = materialise(silver.accepted(tracks, source), "accepted")
    merge_events(spark, f"{root}/events", new, full)
    profile = silver.profile(load_events(spark, f"{root}/events")).first().asDict()
    rows = profile["scrobble_count"]
    counts["duplicates_removed"] = before + counts["completed_scrobbles"] - rows
    replace_rejects(silver.rejected(tracks), f"{root}/rejects/batch={landing.now().replace(':', '')}")
    replace_table(ids if done is None else done.select("run_id").unionByName(ids), f"{root}/processed_runs")
    write_json(spark, f"{root}/_metadata.json", {"last_transformed_at": landing.now(), "row_count": rows, "schema_version": 1, "last_run": counts | {"profile": profile}})
    for df in (tracks, new):
        discard(df)
    return {"runs": ids.count(), "events": rows, **counts, **profile}


def build_gold(spark: SparkSession, events_path: str, root: str, boundary: str = gold.BOUNDARY) -> dict:
    """The activity marts of an event table, checked and published together."""
    events = load_events(spark, events_path)
    marts = gold.build_marts(events, boundary)
    checked = gold.validate_marts(marts, events.count())
    facts = gold.profile(events, marts, boundary).first().asDict()
    ordered = {n: gold.in_order(df, gold.SORTED[n]) for n, df in marts.items()}
    source = (read_json(spark, f"{events_path.rsplit('/', 1)[0]}/_metadata.json") or {}).get("last_transformed_at")
    rows = publish(ordered, root, lambda r: {"generated_at": landing.now(), "source_silver_updated_at": source, "tracking_boundary": boundary, "schema_version": 1, "quality": checked, "profile": facts, "marts": r})
    spark.catalog.clearCache()
    return {"marts": rows, "profile": facts, "quality": checked}


def build_enriched(
    spark: SparkSession, events_path: str, artists_path: str, tags_path: str, taxonomy: DataFrame, periods: list[Period], root: str, boundary: str = gold.BOUNDARY,
    most_tags: int = enriched.MAX_TAGS, current_year: int | None = None,
) -> dict:
    """The enriched marts, checked and published together with coverage figures and insights."""
    year = current_year or datetime.now(timezone.utc).year
    silver_events = load_events(spark, events_path)
    artists = spark.read.parquet(artists_path)
    events = enriched.keyed(silver_events, boundary).persist()
    enriched.check_bridge(events, artists)
    weights = enriched.tag_weights(spark.read.parquet(tags_path), taxonomy, most_tags).persist()
    marts = enriched.build_marts(events, gold.prepare(silver_events, boundary), artists, weights, periods, year)
    for name, df in marts.items():
        quality.require(df, quality.mart_rules(df), name)
    n = silver_events.count()
    quality.conserved(n, {"diversity": (marts["diversity"], "scrobbles"), "time_patterns": (marts["time_patterns"], "scrobbles")})
    facts = {"quality": enriched.coverage(events, artists, weights).first().asDict() | {"silver_events": n}, "profile": enriched.profile(events).first().asDict()}
    from .consumer import insights

    found = {k: [r.asDict() for r in df.collect()] for k, df in insights(marts).items()}  # a few rows each
    ordered = {k: gold.in_order(df, enriched.SORTED[k]) for k, df in marts.items()}
    rows = publish(ordered, root, lambda r: facts | {"generated_at": landing.now(), "schema_version": 1, "marts": r, "insights": found})
    spark.catalog.clearCache()
    return facts | {"marts": rows, "insights": found}


def fetch_answers(asked: DataFrame, cache: ResponseCache, entities: EntityProvider | None, tags: TagProvider | None, progress: Callable[[list[str], list[tuple[str, str, str]]], None] | None = None, every: int = 10) -> dict[str, int]:
    """Ask the providers for what the cache lacks, on the driver and one by one, as their rate limits demand. Every answer is
    in the cache before the next is asked, so nothing is lost between two calls of ``progress``, which takes the keys and the
    requests of the last ``every`` artists."""
    keys: list[str] = []
    requests: list[tuple[str, str, str]] = []
    stats = {"api_requests": 0, "errors": 0}

    def ask(provider: str, kind: str, identity: str, call: Callable[[], object]) -> dict:
        requests.append((provider, kind, identity))
        known = cache.load(provider, kind, identity)
        if known and known["status"] != "error":
            return known
        stats["api_requests"] += 1
        try:
            answer = call()
            return cache.store(provider, kind, identity, "success" if answer else "not_found", answer)
        except SourceError as e:
            stats["errors"] += 1
            return cache.store(provider, kind, identity, "error", error=type(e).__name__)

    for i, r in enumerate(asked.select("artist_key", "source_artist_name", "request_identity").toLocalIterator(), 1):
        name = r.source_artist_name
        if entities:
            direct = None
            if r.request_identity.startswith("mbid:"):
                direct = ask("entities", "artist", r.request_identity, lambda: entities.by_id(r.request_identity[5:]))  # noqa: B023
            known = (direct or {}).get("response")
            if not isinstance(known, dict) or f"mbid:{known.get('id')}" != r.request_identity:

                def search() -> dict | None:
                    found = entities.search(name)  # noqa: B023
                    return {"artists": found} if found else None

                ask("entities", "artist", f"name:{canonical(name)}", search)
        if tags:
            ask("tags", "artist", r.artist_key, lambda: tags.top_tags(name))  # noqa: B023
        keys.append(r.artist_key)
        if progress and i % every == 0:
            progress(keys[:], requests[:])
            keys.clear()
            requests.clear()
    return stats


_CANDIDATE = "array<struct<id string, name string, `sort-name` string, score int, aliases array<struct<name string>>>>"


def resolved_artists(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Artist rows from cached answers alone: the direct answer where there is one; else the candidates of the name search."""
    by_name = F.concat(F.lit("name:"), enrichment.canonical_text("source_artist_name"))
    direct = enrichment.from_cache(asked, cache, "entities", "artist").withColumnsRenamed({"status": "s1", "response": "d1", "retrieved_at": "t1"})
    search = enrichment.from_cache(direct.withColumnRenamed("request_identity", "asked_identity").withColumn("request_identity", by_name), cache, "entities", "artist").withColumnsRenamed({"status": "s2", "response": "d2", "retrieved_at": "t2"})
    is_id = F.col("resolution_method") != "search_match"
    right = F.coalesce(F.concat(F.lit("mbid:"), F.get_json_object("d1", "$.id")) == F.col("asked_identity"), F.lit(False))
    use = F.when(is_id & right, "direct").when(is_id & F.coalesce(~F.col("s1").isin("not_found", "success"), F.lit(True)), "error")
    rows = materialise(search.withColumn("use", use.when(F.col("s2") == "success", "search").when(F.col("s2") == "not_found", "none").otherwise("error")), "answers")
    found = F.from_json(F.get_json_object("d2", "$.artists"), _CANDIDATE)
    one = rows.where("use = 'search'").select("artist_key", F.explode(found).alias("c"))
    cands = one.select("artist_key", "c.id", "c.name", F.col("c.sort-name").alias("sort_name"), "c.score", F.transform("c.aliases", lambda a: a["name"]).alias("aliases"))
    asked_names = rows.where("use = 'search'").select("artist_key", F.col("source_artist_name").alias("name"))
    verdict = enrichment.resolve(asked_names, cands)
    docs = rows.where("use = 'search'").select("artist_key", F.explode(F.from_json(F.get_json_object("d2", "$.artists"), "array<string>")).alias("doc"))
    doc = docs.withColumn("candidate_id", F.get_json_object("doc", "$.id")).groupBy("artist_key", "candidate_id").agg(F.first("doc").alias("found_doc"))
    j = rows.join(verdict, "artist_key", "left").join(doc, ["artist_key", "candidate_id"], "left")
    j = j.withColumns({
        "response": F.when(F.col("use") == "direct", F.col("d1")).when(F.col("status") == "resolved", F.col("found_doc")),
        "resolution_status": F.when(F.col("use") == "direct", "resolved").when(F.col("use") == "none", "not_found").when(F.col("use") == "error", "error").otherwise(F.col("status")),
        "resolution_confidence": F.when(F.col("use") == "direct", "high").otherwise(F.col("confidence")),
        "resolution_method": F.when((F.col("use") == "search") | (F.col("use") == "none"), "search_match").otherwise(F.col("resolution_method")),
        "musicbrainz_retrieved_at": F.when(F.col("use") == "direct", F.col("t1")).otherwise(F.col("t2")), "enriched_at": F.lit(landing.now()),
    })
    return conform(enrichment.artist_fields(j), ARTISTS)


def enrich_artists(
    spark: SparkSession, events_path: str, cache_root: str, root: str, entities: EntityProvider | None = None, tags: TagProvider | None = None, limit: int | None = None,
    from_cache: bool = False, overrides: DataFrame | None = None, tag_limit: int = 20, source: str = "provider", every: int = 10,
) -> dict:
    """Artists and tags at ``root``/artists and ``root``/artist_tags, where those of every ``every`` artists can be read while
    the others are still asked for. Rows that are there and no error are kept as they are
    and cost no request; with ``from_cache`` no request is made at all."""
    events = load_events(spark, events_path)
    asked = enrichment.best_identity(enrichment.by_volume(enrichment.entities(events), limit), overrides)
    asked = materialise(asked, "asked")
    kept = load_or_none(spark, f"{root}/artists")
    if kept is not None:
        kept = materialise(kept.where("resolution_status <> 'error'"), "kept")
        asked = dedup.absent(asked, kept, ["artist_key"])
    stats = {"api_requests": 0, "errors": 0}
    made = lambda cache, of: resolved_artists(asked if of is None else asked.where(F.col("artist_key").isin(of)), cache)

    def tagged(cache: DataFrame, of: DataFrame) -> DataFrame:
        answers = cache.where("provider = 'tags' and status = 'success'").select(F.col("request_identity").alias("artist_key"), "retrieved_at", "response")
        return conform(enrichment.tags_of(dedup.present(answers, of.select("artist_key"), ["artist_key"]), limit=tag_limit, source=source), TAGS)

    def checkpoint(keys: list[str], requests: list[tuple[str, str, str]]) -> None:
        """The last few artists and their tags are appended; the whole tables take their place at the end."""
        some = ResponseCache(cache_root).frame(spark, requests)
        rows = materialise(made(some, keys).where("resolution_status <> 'error'"), "checkpoint")
        tagged(some, rows).write.mode("append").parquet(f"{root}/artist_tags")
        rows.write.mode("append").parquet(f"{root}/artists")
        discard(rows)

    if not from_cache:
        stats = fetch_answers(asked, ResponseCache(cache_root), entities, tags, checkpoint, every)
    cache = cached_responses(spark, cache_root)
    fresh = made(cache, None)
    replace_table(fresh if kept is None else kept.unionByName(fresh), f"{root}/artists")
    replace_table(tagged(cache, spark.read.parquet(f"{root}/artists")), f"{root}/artist_tags")
    covered = enrichment.coverage(events, spark.read.parquet(f"{root}/artists"), spark.read.parquet(f"{root}/artist_tags")).first().asDict()
    write_json(spark, f"{root}/_metadata.json", {"generated_at": landing.now(), "coverage": covered, "stats": stats})
    return stats | covered
