"""Rows of plays made comparable: user, time, artist as linked by the name operator, and title key."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charform import normal_form
from .titles import title_key


def _key_of(name: str) -> str:
    return hashlib.sha256(re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name).strip()).encode()).hexdigest()


def _map_distinct(col: pa.Array, fn) -> pa.Array:
    d = col.dictionary_encode()
    return pa.DictionaryArray.from_arrays(d.indices, pa.array(fn(d.dictionary), pa.string())).cast(pa.string())


def _keys(names: pa.Array) -> list[str | None]:
    return [None if x is None else _key_of(x) for x in names.to_pylist()]


def _titles(names: pa.Array) -> list[str | None]:
    return [None if x is None else title_key(x) for x in normal_form(names)[0].to_pylist()]


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [*b.columns[:4], _map_distinct(b.column(4), _keys), _map_distinct(b.column(5), _titles)]
        yield pa.RecordBatch.from_arrays(cols, ["row_no", "user", "t", "run", "artist_key", "title"])


def play_rows(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(row_no, user, t, run, artist, title) of each row with user, time, artist and track; t in microseconds.

    ``clusters`` is (key, cluster) of :func:`entities.link_names`; a name without a row there is its own artist.
    """
    ready = rows.select(
        F.col("row_no").cast("bigint"), F.lower(F.regexp_replace("user", r"(?U)^\s+|\s+$", "")).alias("user"),
        F.unix_micros(F.col("scrobbled_at").cast("timestamp")).alias("t"), F.col("bronze_run_id").alias("run"), "artist_name", "track_name",
    ).where("user is not null and t is not null and artist_name is not null and track_name is not null")
    keyed = ready.mapInArrow(_prepare, "row_no bigint, user string, t bigint, run string, artist_key string, title string")
    twice = [F.xxhash64("key"), F.xxhash64(F.reverse("key"))]  # 128 bits stand for a name's key
    slim = keyed.withColumnRenamed("artist_key", "key").withColumns(dict(zip(("k", "l"), twice, strict=True))).drop("key")
    ids = clusters.select(twice[0].alias("k"), twice[1].alias("l"), "cluster").groupBy("k", "l").agg(F.min("cluster").alias("cluster"))
    return slim.join(ids, ["k", "l"], "left").select("row_no", "user", "t", "run", F.coalesce("cluster", "k").alias("artist"), "title")
