"""Publishing tables: staged, read back, swapped in, description last.

Paths are Hadoop paths, so the same code serves a local disk and a cluster's file system.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import ContractError

#: Marts that are kept inside another mart's folder.
PLACES = {"streaks": "listening_patterns/streaks"}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _swap(spark: SparkSession, staged: str, target: str) -> None:
    """Rename ``staged`` to ``target``; what was there is set aside first and removed after."""
    fs, to = _fs(spark, target)
    _, frm = _fs(spark, staged)
    parent, _, name = target.rstrip("/").rpartition("/")
    _, aside = _fs(spark, f"{parent}/_old-{uuid.uuid4().hex[:8]}-{name}")  # a name that readers pass over
    fs.mkdirs(to.getParent())
    had = fs.exists(to)
    if had:
        fs.rename(to, aside)
    if not fs.rename(frm, to):
        if had:
            fs.rename(aside, to)
        raise OSError(f"could not publish {target}")
    if had:
        fs.delete(aside, True)


def replace_table(df: DataFrame, path: str, by: str | None = None, only_parts: bool = False) -> int:
    """Write ``df`` beside ``path``, read it back, and swap it in; the plan may read ``path`` itself. Returns the rows.

    ``by`` is a column that makes a folder for each of its values. With ``only_parts`` the folders of the values in ``df`` are
    swapped one by one and the others stay as they are; each is whole at any time."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:8]}"
    try:
        if by is None:
            df.write.parquet(staged)
            back = spark.read.parquet(staged)
        else:
            df.hint("rebalance", by).write.partitionBy(by).parquet(staged)
            back = spark.read.schema(df.schema).parquet(staged)
        if sorted(f.name for f in back.schema) != sorted(df.columns):
            raise ContractError(f"{path}: read back with other columns")
        rows = back.count()
        if only_parts:
            fs, p = _fs(spark, staged)
            for part in sorted(s.getPath().getName() for s in fs.listStatus(p)):
                if part.startswith(f"{by}="):
                    _swap(spark, f"{staged}/{part}", f"{path.rstrip('/')}/{part}")
        else:
            _swap(spark, staged, path)
        return rows
    finally:
        fs, p = _fs(spark, staged)
        fs.delete(p, True)


def replace_rejects(df: DataFrame, path: str) -> int:
    """Rejected records as JSON lines; nothing is left at ``path`` where there are none. Partitioned by run, so that a later
    batch leaves the rejects of earlier runs alone: ``path`` should be one batch's folder."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if df.isEmpty():
        fs.delete(p, True)
        return 0
    df.write.mode("overwrite").partitionBy("bronze_run_id").json(path)
    return spark.read.json(path).count()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written under another name and renamed."""
    fs, p = _fs(spark, path)
    _, part = _fs(spark, f"{path}.part-{uuid.uuid4().hex[:8]}")
    fs.mkdirs(p.getParent())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)  # not spark.read, which passes over names with an underscore
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    write_text(spark, path, json.dumps(document, ensure_ascii=False, indent=2, default=str) + "\n")


def read_json(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, path)
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def publish(marts: dict[str, DataFrame], root: str, describe) -> dict[str, int]:
    """All marts of a build, or none: each is staged and read back; then they are swapped in; the description, made by
    ``describe(rows by mart)``, comes last, so that it never speaks of marts that are not there."""
    spark = next(iter(marts.values())).sparkSession
    stage = f"{root.rstrip('/')}.stage-{uuid.uuid4().hex[:8]}"
    try:
        rows = {}
        for name, df in marts.items():
            df.write.parquet(f"{stage}/{name}")
            rows[name] = spark.read.parquet(f"{stage}/{name}").count()
        document = describe(rows)
        for name in sorted(marts, key=lambda n: PLACES.get(n, n).count("/")):
            _swap(spark, f"{stage}/{name}", f"{root.rstrip('/')}/{mart_path(name)}")
        write_json(spark, f"{root.rstrip('/')}/_metadata.json", document)
        return rows
    finally:
        fs, p = _fs(spark, stage)
        fs.delete(p, True)


def mart_path(name: str) -> str:
    """Where a mart is kept below the root. A mart inside another's folder has its own folder there."""
    return PLACES.get(name, f"{name}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def local(path: str) -> Path:
    return Path(path.removeprefix("file://"))
