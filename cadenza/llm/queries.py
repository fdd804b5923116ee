"""The pN_ queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from ..storage import materialise, work_folder
from . import charform, cooccur, entities, history, packing, plays, repeats, spans, tokens


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return charform.not_in_form(load(spark, root, "scrobbles"), "row_no", ["artist_name", "track_name", "album_name"])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return entities.same_pairs(entities.link_names(load(spark, root, "artist_profile")))


def p4_classes(spark: SparkSession, root: str) -> DataFrame:
    """Each artist row with its class, named by the least key in it, and the number of other rows in it: membership, however
    many spellings an artist has."""
    of = materialise(entities.link_names(load(spark, root, "artist_profile")), "clusters")
    sizes = of.groupBy("cluster").agg(F.min("key").alias("class"), (F.count_distinct("key") - 1).alias("n_links"))
    return of.join(sizes, "cluster").select(F.col("key").alias("artist_key"), "class", "n_links").distinct()


def _plays(spark: SparkSession, root: str) -> DataFrame:
    clusters = entities.link_names(load(spark, root, "artist_profile"))
    return plays.play_rows(load(spark, root, "scrobbles"), clusters)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    kept = history.ChunkHistory(spark, f"{work_folder(spark)}/history-{uuid.uuid4().hex}")
    return history.repeated_deliveries(_plays(spark, root), kept)


def p2_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every run of the same track of a user as one event with its rows and duration."""
    events = _plays(spark, root).select("row_no", F.col("user").alias("entity"), "t", F.col("artist").alias("item"), F.col("title").alias("text"))
    runs = repeats.repeated_runs(materialise(events, "events"))
    return runs.select(F.col("entity").alias("user_key"), "row0", "row1", F.col("n").alias("n_rows"), ((F.col("t1") - F.col("t0")) / F.lit(1_000_000)).cast("bigint").alias("duration_s"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    runs = p2_runs(spark, root).where("n_rows > 1")
    return runs.select(F.least("row0", "row1").alias("row_no_a"), F.greatest("row0", "row1").alias("row_no_b"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.token_ids(load(spark, root, "documents"))


def p9_pack(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(tokens.token_counts(load(spark, root, "documents")), 2048)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    index = spans.FingerprintIndex(spark, f"{work_folder(spark)}/index-{uuid.uuid4().hex}")
    return spans.shared_spans(load(spark, root, "documents"), index)


def p10_shares(spark: SparkSession, root: str) -> DataFrame:
    """How much of each text stands elsewhere too, texts without such stretches and null texts included."""
    found = p10_found(spark, root).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    docs = load(spark, root, "documents").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    out = docs.join(found, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("n_shared") / F.col("n_chars")).otherwise(F.lit(0.0)))


def p5_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every pair of tags that some artist carries, with its lift."""
    pairs = cooccur.pair_counts(load(spark, root, "artist_tags"), F.col("artist_key"), F.col("tag_normalized"))
    lift = F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))
    return pairs.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), "n_a", "n_b", "n_ab", F.round(lift, 6).alias("lift"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = cooccur.pair_counts(load(spark, root, "artist_tags"), F.col("artist_key"), F.col("tag_normalized"), least=5)
    return cooccur.lifted(pairs, 3).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_runs": p2_runs, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_pairs": p5_pairs,
    "p6_found": p6_found, "p8_ids": p8_ids, "p9_pack": p9_pack, "p10_found": p10_found, "p10_shares": p10_shares,
}

BASKETS = """
WITH b AS (SELECT DISTINCT artist_key, tag_normalized AS tag FROM artist_tags WHERE artist_key IS NOT NULL AND regexp_matches(tag_normalized, '\\S')),
f AS (SELECT tag, count(*) AS n FROM b GROUP BY tag),
t AS (SELECT count(DISTINCT artist_key) AS n FROM b),
p AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n_ab FROM b x JOIN b y ON x.artist_key = y.artist_key AND x.tag < y.tag GROUP BY 1, 2),
r AS (SELECT tag_a, tag_b, fa.n AS n_a, fb.n AS n_b, n_ab, t.n AS n_baskets FROM p JOIN f fa ON fa.tag = tag_a JOIN f fb ON fb.tag = tag_b CROSS JOIN t)
"""
# Classes of characters that are not in the consistent form, as far as the test tables hold them.
_WIDE = r"\x{FF01}-\x{FFEF}\x{FB00}-\x{FB06}\x{2150}-\x{217F}\x{01C4}-\x{01CC}\x{03D0}-\x{03D6}\x{03F0}-\x{03F2}\x{03F4}\x{03F5}\x{2026}\x{00B2}\x{00B3}\x{00B9}\x{00BC}-\x{00BE}"
_UNSEEN = r"\x{00AD}\x{034F}\x{061C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}"
_BLANK = r"\t\n\v\f\r\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MIXED = r"\p{Latin}[\p{M}'’]*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{M}'’]*\p{Latin}|\x{0251}[\p{L}\p{M}]|[\p{L}\p{M}]\x{0251}"
_ODD = f"[{_WIDE}{_UNSEEN}{_BLANK}]|{_MIXED}".replace("'", "''")
_FIELDS = " UNION ALL ".join(f"SELECT row_no, '{c}' AS field_name, {c} AS v FROM scrobbles" for c in ("artist_name", "track_name", "album_name"))
SPANS = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i, md5(substring(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS f FROM w WHERE h IN (SELECT h FROM s)),
r AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM c),
o AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM r GROUP BY doc_id, k)
"""
SQL: dict[str, str] = {
    "p6_found": f"SELECT row_no, field_name FROM ({_FIELDS}) WHERE v <> nfc_normalize(v) OR regexp_matches(v, '{_ODD}')",
    "p10_found": SPANS + "SELECT * FROM o",
    "p10_shares": SPANS + """, g AS (SELECT doc_id, count(*) AS n, sum(span_end - span_start)::BIGINT AS m FROM o GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0) AS n_spans, coalesce(m, 0) AS n_shared, CASE WHEN length(text) > 0 THEN coalesce(m, 0) / length(text)::DOUBLE ELSE 0 END AS share
FROM documents LEFT JOIN g USING (doc_id)""",
    "p5_found": BASKETS + "SELECT tag_a, tag_b FROM r WHERE n_ab >= 5 AND n_ab * n_baskets >= 3 * n_a * n_b",
    "p5_pairs": BASKETS + "SELECT tag_a, tag_b, n_a, n_b, n_ab, round(n_ab * n_baskets / (n_a * n_b)::DOUBLE, 6) AS lift FROM r",
}
