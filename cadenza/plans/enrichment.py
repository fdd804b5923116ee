"""Artist entities, their resolution against candidates, tags of provider responses, coverage. All of it set-based."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import artist_key, canonical_text, tag_normalized
from ..storage import materialise
from .gold import one_row


def entities(events: DataFrame, order: tuple[str, ...] = ("scrobbled_at", "bronze_run_id", "bronze_page", "scrobble_id")) -> DataFrame:
    """(artist_key, source_artist_name, existing_artist_mbid, scrobble_count, first_seen, last_seen): one row for an artist.

    The name is the most frequent spelling, ties by name; the id is the first non-blank one in the order of events. Spellings
    are counted before the key is made, so a hot artist is a few rows.
    """
    blank = F.trim(F.coalesce("artist_mbid", F.lit(""))) == ""
    first = F.min(F.when(~blank, F.struct(*order, "artist_mbid")))
    names = events.where("artist_name is not null").groupBy("artist_name").agg(F.count("*").alias("n"), first.alias("m"), F.min("scrobbled_at").alias("s"), F.max("scrobbled_at").alias("e"))
    keyed = names.withColumn("artist_key", artist_key("artist_name"))
    return keyed.groupBy("artist_key").agg(
        F.min_by("artist_name", F.struct(-F.col("n"), "artist_name")).alias("source_artist_name"), F.min("m")["artist_mbid"].alias("existing_artist_mbid"),
        F.sum("n").alias("scrobble_count"), F.min("s").alias("first_seen"), F.max("e").alias("last_seen"),
    )


def by_volume(artists: DataFrame, limit: int | None = None) -> DataFrame:
    """Entities with the most events first; ``limit`` is the feature of working on the largest ones only."""
    out = artists.orderBy(F.desc("scrobble_count"), "source_artist_name")
    return out if limit is None else out.limit(limit)


def resolve(requests: DataFrame, candidates: DataFrame, sure_score: int = 95) -> DataFrame:
    """(artist_key, status, confidence, candidate_id, candidate_count) of requests (artist_key, name) and candidates
    (artist_key, id, name, sort_name, score, aliases array<string>).

    No candidate: not_found. One whose name, sort name or an alias is the name: resolved, high. More: ambiguous, low. None,
    but one with the sure score: resolved, medium. Else ambiguous, low. Names are compared in canonical form.
    """
    all_names = F.filter(F.concat(F.array("name", "sort_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    spelled = candidates.select("artist_key", "id", "score", F.explode(all_names).alias("spelling")).withColumn("spelling", canonical_text("spelling"))
    asked = requests.select("artist_key", canonical_text("name").alias("wanted"))
    hit = spelled.join(asked, "artist_key").groupBy("artist_key", "id").agg(F.max(F.col("spelling") == F.col("wanted")).alias("exact"))
    scored = candidates.groupBy("artist_key", "id").agg(F.max(F.coalesce("score", F.lit(0))).alias("score")).join(hit, ["artist_key", "id"], "left")
    exact, sure = F.coalesce("exact", F.lit(False)), F.col("score") >= sure_score
    per = scored.groupBy("artist_key").agg(
        F.count("*").alias("candidate_count"), F.count_if(exact).alias("exacts"), F.count_if(sure).alias("sures"),
        F.min(F.when(exact, F.col("id"))).alias("exact_id"), F.min(F.when(sure, F.col("id"))).alias("sure_id"),
    )
    return decided(requests, per)


def decided(requests: DataFrame, per: DataFrame) -> DataFrame:
    """The outcome of each request, from what is known of its candidates: (artist_key, candidate_count, exacts, sures, exact_id, sure_id)."""
    out = requests.select("artist_key").join(per, "artist_key", "left")
    one, two = F.col("exacts") == 1, (F.col("exacts") == 0) & (F.col("sures") == 1)
    return out.select(
        "artist_key",
        F.when(F.col("candidate_count").isNull(), "not_found").when(one | two, "resolved").otherwise("ambiguous").alias("status"),
        F.when(F.col("candidate_count").isNull(), None).when(one, "high").when(two, "medium").otherwise("low").alias("confidence"),
        F.when(one, F.col("exact_id")).when(two, F.col("sure_id")).alias("candidate_id"), F.coalesce("candidate_count", F.lit(0)).cast("bigint").alias("candidate_count"),
    )


def best_identity(artists: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Entities with the identity to look up: an override's id, else the id seen in events, else the name."""
    df = artists if overrides is None else artists.join(overrides.select("source_artist_name", F.col("musicbrainz_artist_id").alias("override")), "source_artist_name", "left")
    over = F.col("override") if overrides is not None else F.lit(None).cast("string")
    ident = F.coalesce(over, F.col("existing_artist_mbid"))
    method = F.when(over.isNotNull(), "manual_override").when(F.col("existing_artist_mbid").isNotNull(), "existing_mbid").otherwise("search_match")
    identity = F.when(ident.isNotNull(), F.concat(F.lit("mbid:"), ident)).otherwise(F.concat(F.lit("name:"), canonical_text("source_artist_name")))
    return df.withColumns({"request_identity": identity, "resolution_method": method}).drop("override")


def from_cache(asked: DataFrame, cache: DataFrame, provider: str, entity_type: str) -> DataFrame:
    """Requests with the cached answer, where there is one with a known status."""
    known = cache.where((F.col("provider") == provider) & (F.col("entity_type") == entity_type) & F.col("status").isin("success", "not_found", "error"))
    return asked.join(known.select("request_identity", "status", "response", "retrieved_at"), "request_identity", "left")


def artist_fields(answers: DataFrame, doc: str = "response") -> DataFrame:
    """``answers`` with the fields of an artist document in JSON text; what is absent or no object is null."""
    get = lambda p: F.get_json_object(doc, p)
    paths = {
        "musicbrainz_artist_id": "$.id", "canonical_name": "$.name", "sort_name": "$['sort-name']", "artist_type": "$.type", "country": "$.country", "area": "$.area.name",
        "begin_area": "$['begin-area'].name", "begin_date": "$['life-span'].begin", "end_date": "$['life-span'].end", "disambiguation": "$.disambiguation",
    }
    return answers.withColumns({k: get(p) for k, p in paths.items()})


def tags_of(answers: DataFrame, doc: str = "response", limit: int = 20, source: str = "provider") -> DataFrame:
    """(artist_key, tag, tag_normalized, tag_count, tag_rank, source, retrieved_at) of tag answers (artist_key, retrieved_at,
    response as JSON text): the first ``limit`` elements; the rank is the place before blank names are dropped; a lone object
    is a list of one; a count that is no number or negative is 0; of equal normalised tags of an artist the first stays."""
    v = F.try_parse_json(doc)
    listed = F.try_variant_get(v, "$.toptags.tag", "array<variant>")
    lone = F.try_variant_get(v, "$.toptags.tag", "variant")
    rows = answers.select("artist_key", "retrieved_at", F.posexplode(F.slice(F.coalesce(listed, F.when(lone.isNotNull(), F.array(lone))), 1, limit)).alias("pos", "t"))
    name = F.regexp_replace(F.try_variant_get(F.col("t"), "$.name", "string"), r"(?U)^\s+|\s+$", "")
    rows = rows.select("artist_key", name.alias("tag"), F.greatest(F.coalesce(F.expr("try_cast(try_variant_get(t, '$.count', 'string') as bigint)"), F.lit(0)), F.lit(0)).alias("tag_count"), (F.col("pos") + 1).alias("tag_rank"), F.lit(source).alias("source"), "retrieved_at")
    rows = rows.where("tag <> ''").withColumn("tag_normalized", tag_normalized("tag"))
    first = F.row_number().over(Window.partitionBy("artist_key", "tag_normalized").orderBy("tag_rank"))
    rows = rows.withColumn("k", first).where("k = 1")
    return rows.select("artist_key", "tag", "tag_normalized", F.col("tag_count").cast("bigint"), F.col("tag_rank").cast("int"), "source", "retrieved_at")


def coverage(events: DataFrame, artists: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: artists by resolution, and the shares of evaluated artists, and of their events, that are resolved or tagged.
    Events are counted by name before anything is joined."""
    names = events.where("artist_name is not null").groupBy("artist_name").agg(F.count("*").alias("n")).withColumn("artist_key", artist_key("artist_name"))
    counts = materialise(names.groupBy("artist_key").agg(F.sum("n").alias("n")), "counts")  # read twice
    tagged = tags.select("artist_key").where("artist_key is not null").distinct().withColumn("tagged", F.lit(1))
    own = artists.groupBy("artist_key").agg(F.max("resolution_status").alias("status"))
    j = own.join(tagged, "artist_key", "left").join(counts, "artist_key", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "tagged": F.coalesce("tagged", F.lit(0)), "resolved": (F.col("status") == "resolved").cast("int")})
    pct = lambda a, b: F.coalesce(F.bround(F.lit(100) * a / F.nullif(b, F.lit(0)), 3), F.lit(0.0))
    n, one = F.sum("n"), F.count("*")
    row = j.agg(
        one.alias("evaluated_artists"), *[F.count_if(F.col("status") == s).alias(f"{s}_artists") for s in ("resolved", "ambiguous", "not_found", "error")],
        pct(F.sum("resolved"), one).alias("entity_coverage_pct"), pct(F.sum(F.col("n") * F.col("resolved")), n).alias("event_coverage_pct"),
        F.coalesce(F.sum("tagged"), F.lit(0)).alias("tagged_artists"), pct(F.sum("tagged"), one).alias("tag_entity_coverage_pct"), pct(F.sum(F.col("n") * F.col("tagged")), n).alias("tag_event_coverage_pct"),
    )
    total = counts.agg(F.count("*").alias("unique_artists"))
    return one_row(total, row)
