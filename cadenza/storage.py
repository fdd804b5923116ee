"""Tables written in the middle of a plan: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where that is unset and the master is local (tests, a single machine) a temporary folder is made, set and
    removed at exit. On a cluster without the setting this raises: a machine-local folder would lose data.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="cadenza-")
    atexit.register(shutil.rmtree, root, True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_folder(spark: SparkSession) -> str:
    """This application's own folder under the shared root."""
    return f"{shared_root(spark)}/cadenza/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete everything this application has written in the middle of its plans; results must have been written by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to its own folder under the shared root and return a scan of it."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`materialise` once nothing lazy reads them any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
