"""The nested pages of run payloads as flat tables of pages, track elements and artist references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.nested import dewey_nodes, flat_table
from ..storage import materialise

PAGE = "/pages"
TRACK = "/pages/payload/recenttracks/track"
REFS = {f"{TRACK}/artist": "artist", f"{TRACK}/credits/artist": "credit_artist", f"{TRACK}/credits/members": "credit_member"}
META_PAGE, ATTR_PAGE = "/pages/metadata/page", "/pages/payload/recenttracks/@attr/page"


def _depth(path: str) -> int:
    return 2 * path.count("/")


def _int(c):
    return F.expr(f"try_cast(trim({c}) as int)")


def paths_of(path: str, fields: dict[str, str]) -> list[str]:
    """The schema paths that a flat table is made of."""
    return [path, *[f"{path}/{member}" for member in fields.values()]]


def page_numbers(nodes: DataFrame) -> DataFrame:
    """(doc_key, page_label, page): metadata.page, or "@attr".page of the payload where that is missing."""
    at = nodes.where(F.col("path").isin(META_PAGE, ATTR_PAGE)).withColumn("page_label", F.slice("label", 1, _depth(PAGE)))
    one = lambda p: F.min(F.when(F.col("path") == p, _int("value")))
    return at.groupBy("doc_key", "page_label").agg(F.coalesce(one(META_PAGE), one(ATTR_PAGE)).alias("page"))


def artist_ids(runs: DataFrame, key: str = "run_id", doc: str = "payload") -> DataFrame:
    """(run_id, page, track_pos, artist_mbid): each different non-blank id of an artist reference in a track element.

    One pass over the texts keeps the id and page nodes; everything else is label arithmetic. track_pos is the ordinal of
    the track element in its label. Pages without any readable number give a null page; a payload that is null or cut off
    gives nothing; repeated rows and pages saved twice give one row.
    """
    ids = [f"{p}/mbid" for p in REFS]
    nodes = materialise(dewey_nodes(runs, key, doc, [*ids, META_PAGE, ATTR_PAGE]), "nodes")  # parsed once, read twice
    refs = nodes.where(F.col("path").isin(ids) & (F.col("kind") == "string")).select(
        "doc_key",
        F.slice("label", 1, _depth(PAGE)).alias("page_label"),
        F.element_at("label", _depth(TRACK)).alias("track_pos"),
        F.lower(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).alias("artist_mbid"),
    )
    found = refs.where("artist_mbid <> ''").distinct().join(page_numbers(nodes), ["doc_key", "page_label"], "left")
    return found.select(F.col("doc_key").alias("run_id"), "page", "track_pos", "artist_mbid").distinct()


def page_table(runs: DataFrame, key: str = "run_id", doc: str = "payload") -> DataFrame:
    """(run_id, label, parent_label, page, user, total_pages): one row for each page element that is an object."""
    fields = {"meta_page": "metadata/page", "attr_page": "payload/recenttracks/@attr/page", "user": "payload/recenttracks/@attr/user", "total_pages": "payload/recenttracks/@attr/totalPages"}
    t = flat_table(dewey_nodes(runs, key, doc, paths_of(PAGE, fields)), PAGE, fields)
    page = F.coalesce(_int("meta_page"), _int("attr_page"))
    return t.select(F.col("doc_key").alias("run_id"), "label", "parent_label", page.alias("page"), "user", _int("total_pages").alias("total_pages"))


def track_table(runs: DataFrame, key: str = "run_id", doc: str = "payload") -> DataFrame:
    """(run_id, label, page_label, track_pos, name, mbid, url, uts, now_playing): one row for each track element that is an object."""
    fields = {"name": "name", "mbid": "mbid", "url": "url", "uts": "date/uts", "now_playing": "@attr/nowplaying"}
    t = flat_table(dewey_nodes(runs, key, doc, paths_of(TRACK, fields)), TRACK, fields)
    return t.select(
        F.col("doc_key").alias("run_id"), "label", F.slice("label", 1, _depth(PAGE)).alias("page_label"),
        F.element_at("label", _depth(TRACK)).alias("track_pos"), "name", "mbid", "url", "uts", "now_playing",
    )


def reference_table(runs: DataFrame, key: str = "run_id", doc: str = "payload") -> DataFrame:
    """(run_id, label, track_label, kind, name, mbid): one row for each artist reference that is an object."""
    fields = {"text": "#text", "plain": "name", "mbid": "mbid"}
    nodes = materialise(dewey_nodes(runs, key, doc, [p for path in REFS for p in paths_of(path, fields)]), "nodes")  # parsed once, read for each kind
    out = None
    for path, kind in REFS.items():
        t = flat_table(nodes, path, fields).select(
            F.col("doc_key").alias("run_id"), "label", F.slice("label", 1, _depth(TRACK)).alias("track_label"),
            F.lit(kind).alias("kind"), F.coalesce("text", "plain").alias("name"), "mbid",
        )
        out = t if out is None else out.unionByName(t)
    return out
