"""New batches against everything accepted before (problem 1).

A record's text is cut where the hash of a byte meets a mask. Each record's chunk hashes and sizes, bound to its context
(entity, group and time window), go into a table that persists between batches. The chunks of a batch are joined with those
of the history in the same contexts; the bytes that two records share are the sum over their common chunks. Pairs with enough
coverage are checked exactly and become links, which persist as well; records that bring a play or an instant of one that was
not there are appended.

The table is partitioned by slots of time: a batch reads only the slots of its own windows, whatever else the history holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .codepoints import utf8
from .graph import components
from .rolling import Ranges
from .titles import SEP, same_title

WINDOW, MASK, COVERAGE = 1, np.uint64(1), 0.25
SECOND, SLOT_S = 1_000_000, 28 * 86_400
RECORD = "id bigint, run string, user string, t bigint, artist bigint, title string, size int, c bigint, hashes array<int>, sizes array<int>"
LINKS = "a bigint, run_a string, b bigint, run_b string"
REPEATS = "row_no bigint, run string, id bigint, first_run string"


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record index, start, end, hash) of the chunks of texts given as UTF-8 with offsets: a chunk ends where the hash of
    the last WINDOW bytes has no bit of MASK, and at the end of the text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    hashes = Ranges(data)
    at = np.arange(n)
    record = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    begin = np.maximum(at - WINDOW + 1, offs[:-1][record])
    end = (hashes.of(begin, at + 1) & MASK) == 0
    end[offs[1:][np.diff(offs) > 0] - 1] = True
    stops = np.flatnonzero(end) + 1
    starts = np.concatenate([[0], stops[:-1]])
    return record[starts], starts, stops, hashes.of(starts, stops)


def _chunk_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(columns..., content) with content replaced by its chunk hashes and sizes; a chunk counts once in a record."""
    for b in batches:
        record, start, stop, h = cut(*utf8(b.column(b.num_columns - 1)))
        h32 = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
        order = np.lexsort((h32, record))
        record, h32, size = record[order], h32[order], (stop - start)[order].astype(np.int32)
        new = np.ones(len(record), bool)
        new[1:] = (record[1:] != record[:-1]) | (h32[1:] != h32[:-1])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(record[new], minlength=len(b)))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[new])) for x in (h32, size)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], [*b.schema.names[:-1], "hashes", "sizes"])


def content():
    """The text of a record that is cut into chunks: its title's words, version and numbers."""
    text = F.trim(F.translate("title", SEP, " "))
    return F.when(text == "", F.lit(SEP)).otherwise(text)


def window(within_s: int, shift_s: int = 0):
    return F.floor((F.col("t") + F.lit(shift_s * SECOND)) / F.lit(2 * within_s * SECOND)).cast("bigint")


def context(w):
    """Hash of (user, artist, window)."""
    return F.xxhash64("user", "artist", w)


def probes(within_s: int):
    """A record's own window and the nearer of its neighbours: every record at most ``within_s`` away is in one of them."""
    own = window(within_s)
    near = F.when(F.pmod(F.col("t"), F.lit(2 * within_s * SECOND)) < within_s * SECOND, own - 1).otherwise(own + 1)
    return F.array(own, near)


def slot_of(w, within_s: int):
    return F.floor(w * F.lit(2 * within_s) / F.lit(SLOT_S)).cast("int")


def records_of(rows: DataFrame) -> DataFrame:
    """(id, run, user, t, artist, title): one record for all rows that are equal in user, t, artist and title; its id is their
    lowest row_no, its run their first."""
    return rows.groupBy("user", "t", "artist", "title").agg(F.min("row_no").alias("id"), F.min("run").alias("run"))


def chunk_table(records: DataFrame, within_s: int) -> DataFrame:
    """Records with size, context and their chunks."""
    rows = records.select("id", "run", "user", "t", "artist", "title", F.octet_length(content()).alias("size"), context(window(within_s)).alias("c"), content().alias("content"))
    return rows.mapInArrow(_chunk_lists, RECORD)


def shared_bytes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(x, y, shared): ids of different records of ``old`` and ``new`` (c, id, hashes, sizes) with common chunks in a common
    context, and the bytes of these chunks."""
    side = lambda d, s: d.select("c", F.col("id").alias(s), F.explode(F.arrays_zip("hashes", "sizes")).alias("p")).select("c", s, F.col("p.hashes").alias("h"), F.col("p.sizes").alias(f"n_{s}"))
    pair = side(old, "x").join(side(new, "y"), ["c", "h"]).where("x <> y")
    return pair.groupBy("x", "y").agg(F.sum(F.least("n_x", "n_y")).alias("shared"))


def _same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.loc[[same_title(x, y) for x, y in zip(b.title_x, b.title_y, strict=True)], ["a", "run_a", "b", "run_b", "same_t"]]


def covered(pairs: DataFrame, old: DataFrame, new: DataFrame, coverage: float) -> DataFrame:
    """Pairs whose shared bytes are at least ``coverage`` of the smaller record, with both records' columns."""
    side = lambda d, s: d.select(*[F.col(c).alias(f"{c}_{s}") for c in ("run", "user", "t", "artist", "title", "size")], F.col("id").alias(s))
    both = pairs.join(side(old, "x"), "x").join(side(new, "y"), "y")
    return both.where(F.col("shared") >= coverage * F.least("size_x", "size_y"))


def same_plays(pairs: DataFrame, within_s: int) -> DataFrame:
    """(a, run_a, b, run_b, same_t), a < b, of covered pairs that are the same play."""
    ok = pairs.where((F.abs(F.col("t_x") - F.col("t_y")) <= within_s * SECOND) & F.expr("user_x = user_y and artist_x = artist_y"))
    first = F.col("x") < F.col("y")
    pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    cols = [F.least("x", "y").alias("a"), pick("run_x", "run_y").alias("run_a"), F.greatest("x", "y").alias("b"), pick("run_y", "run_x").alias("run_b")]
    return ok.select(*cols, F.expr("t_x = t_y").alias("same_t"), "title_x", "title_y").mapInPandas(_same, LINKS + ", same_t boolean").distinct()


class ChunkHistory:
    """The persistent tables under ``path``: ``records`` (chunks and columns of accepted records, by slot of time), ``links``
    (pairs of records of one play) and ``repeats`` (rows beyond the first of their record). A new session finds them there."""

    def __init__(self, spark: SparkSession, path: str, within_s: int = 30, coverage: float = COVERAGE) -> None:
        self.spark, self.path, self.within_s, self.coverage = spark, path.rstrip("/"), within_s, coverage

    def _parts(self, table: str) -> list[str]:
        """Names of what stands directly under a table's folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _table(self, table: str, schema: str) -> DataFrame:
        if not any(n.endswith(".parquet") for n in self._parts(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def near(self, records: DataFrame) -> DataFrame | None:
        """The accepted records in the slots that the windows of ``records`` lie in; None if there are none. The slots are as
        many as the time line has, and are listed on the driver."""
        w = F.explode(probes(self.within_s))
        slots = {f"slot={r[0]}" for r in records.select(w.alias("w")).select(slot_of(F.col("w"), self.within_s)).distinct().collect()}
        found = sorted(slots & set(self._parts("records")))
        return self.spark.read.schema(RECORD).parquet(*[f"{self.path}/records/{s}" for s in found]) if found else None

    def check(self, batch: DataFrame) -> DataFrame:
        """(a, run_a, b, run_b, same_t): the links of the batch's records with the history and with each other. ``batch`` is
        (row_no, user, t, run, artist, title), read from a written table, as ``append`` reads it again; t in microseconds.
        Repeated rows are one record; an empty batch has no links."""
        rows = batch.select("row_no", "user", "t", "run", "artist", "title")
        new = materialise(chunk_table(records_of(rows), self.within_s), "new")
        old = self.near(new)
        stored = new if old is None else old.unionByName(new)
        probing = new.withColumn("w", F.explode(probes(self.within_s))).withColumn("c", context(F.col("w"))).drop("w")
        # only contexts that hold another record are looked into: two numbers of a record, combined before they are shuffled
        at = stored.select("c", "id", F.lit(False).alias("asks")).unionByName(probing.select("c", "id", F.lit(True).alias("asks")))
        busy = at.groupBy("c").agg(F.min("id").alias("i"), F.max("id").alias("j"), F.max("asks").alias("asks")).where("i < j and asks").select("c")
        busy = materialise(busy, "busy")
        left = materialise(stored.join(busy, "c", "left_semi"), "left")
        right = materialise(probing.join(busy, "c", "left_semi"), "right")
        sides = left.dropDuplicates(["id"]), right.dropDuplicates(["id"])
        links = materialise(same_plays(covered(shared_bytes(left, right), *sides, self.coverage), self.within_s), "found")
        self._pending = (rows, new, links)
        return links

    def append(self) -> None:
        """Accept the batch checked last. Its records that deliver a play again at an instant the play already has are left
        out of the history; one at another instant is taken in, as rows within reach of it are the same play too."""
        rows, new, links = self._pending
        again = links.where("same_t").select(F.col("b").alias("id")).distinct()
        slot = slot_of(window(self.within_s), self.within_s)
        fresh = new.join(again, "id", "left_anti").withColumn("slot", slot).hint("rebalance", "slot")
        fresh.write.mode("append").option("compression", "zstd").partitionBy("slot").parquet(f"{self.path}/records")
        links.select("a", "run_a", "b", "run_b").write.mode("append").parquet(f"{self.path}/links")
        keyed = rows.join(new.select("id", F.col("run").alias("first_run"), "user", "t", "artist", "title"), ["user", "t", "artist", "title"])
        keyed.where("row_no <> id").select("row_no", "run", "id", "first_run").write.mode("append").parquet(f"{self.path}/repeats")

    def deliveries(self) -> DataFrame:
        """(row_no_a, row_no_b): each row b so far whose play has a row in an earlier run, with the play's row of the lowest
        number. Reads the links and the repeated rows only."""
        links, repeats = self._table("links", LINKS), self._table("repeats", REPEATS)
        plays = components(links.select("a", "b"))
        linked = links.select(F.col("a").alias("id"), F.col("a").alias("row_no"), F.col("run_a").alias("run")).unionByName(
            links.select(F.col("b").alias("id"), F.col("b").alias("row_no"), F.col("run_b").alias("run"))
        )
        own = repeats.select("id", F.col("id").alias("row_no"), F.col("first_run").alias("run"))
        rows = linked.unionByName(own).unionByName(repeats.select("id", "row_no", "run")).distinct()
        of = rows.join(plays.withColumnRenamed("v", "id"), "id", "left").select("row_no", "run", F.coalesce("component", "id").alias("play"))
        of = materialise(of, "deliveries")
        first = of.groupBy("play").agg(F.min("row_no").alias("row_no_a"), F.min("run").alias("first_run"), F.max("run").alias("last_run")).where("first_run < last_run")
        return of.join(first, "play").where("run > first_run and row_no > row_no_a").select("row_no_a", F.col("row_no").alias("row_no_b"))


def run_batches(rows: DataFrame, batches: int) -> list[DataFrame]:
    """``rows`` in ``batches`` groups of whole runs, in order of run, of about equal size if runs land in order."""
    q = [i / batches for i in range(1, batches)]
    marks = rows.agg(F.percentile_approx("row_no", q).alias("m")).head().m if q else None
    firsts = rows.agg(*[F.min(F.when(F.col("row_no") >= m, F.col("run"))) for m in marks]).head() if marks else []
    edges = sorted({r for r in firsts if r is not None})
    lows, highs = [None, *edges], [*edges, None]
    within = lambda lo, hi: reduce(lambda x, y: x & y, [c for c in (F.col("run") >= lo if lo else None, F.col("run") < hi if hi else None) if c is not None], F.lit(True))
    return [rows.where(within(lo, hi)) for lo, hi in zip(lows, highs, strict=True)]


def repeated_deliveries(rows: DataFrame, history: ChunkHistory, batches: int = 2) -> DataFrame:
    """The ``deliveries`` of ``history`` after all rows have been checked against it and appended, run after run: the runs are
    taken in order in ``batches`` groups, within which rows are checked against each other too, so that the number of groups
    makes no difference. An empty table gives an empty table."""
    rows = materialise(rows, "rows")
    for batch in run_batches(rows, batches):
        history.check(batch)
        history.append()
    return history.deliveries()
