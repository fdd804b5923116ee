"""The landing area of raw pages: run folders with page files and a state file each.

Layout: <root>/ingestion_date=YYYY-MM-DD/run_<id>/page_NNNN.json and run_metadata.json. Single files are written by the driver,
under a temporary name that is renamed; whole collections are read by Spark.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import ContractError
from ..schemas import RUNS

# Names of files and fields of the landing area's layout.
PAGE = re.compile(r"page_(\d{4,})\.json")
STATE = "run_metadata.json"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_json(path: Path, document: Any) -> Path:
    """Write under a temporary name in the same folder, then rename."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=".part-")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2)
        f.write("\n")
    os.replace(name, path)
    return path


def read_json(path: Path) -> Any | None:
    """The document, or None where there is none or it is damaged."""
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def run_folder(root: Path, run_id: str) -> Path:
    day = f"{run_id[:4]}-{run_id[4:6]}-{run_id[6:8]}"
    return root / f"ingestion_date={day}" / f"run_{run_id}"


def new_run(root: Path, mode: str) -> tuple[Path, dict]:
    """A fresh run folder with its state. Two runs of one second get different ids."""
    base = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    run_id, k = base, 0
    while run_folder(root, run_id).exists():
        k += 1
        run_id = f"{base}-{k}"
    state = {"run_id": run_id, "mode": mode, "started_at": now(), "completed_at": None, "status": "running", "pages_saved": [], "expected_pages": None, "failure_type": None}
    folder = run_folder(root, run_id)
    write_json(folder / STATE, state)
    return folder, state


def save_page(folder: Path, page: int, payload: dict, source: str, endpoint: str) -> Path:
    metadata = {"source": source, "endpoint": endpoint, "ingested_at": now(), "page": page}
    return write_json(folder / f"page_{page:04d}.json", {"metadata": metadata, "payload": payload})


def saved_pages(folder: Path) -> list[int]:
    """Numbers of the page files; other files are passed over."""
    return sorted({int(m[1]) for f in folder.iterdir() if (m := PAGE.fullmatch(f.name))})


def runs(spark: SparkSession, root: str) -> DataFrame:
    """State documents of all runs; a damaged one is a row of nulls with its folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", STATE).text(root, wholetext=True)
    doc = F.from_json("value", RUNS)
    return files.select(doc.alias("d"), F.regexp_extract(F.input_file_name(), r"(.*)/[^/]+$", 1).alias("folder")).select("d.*", "folder")


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, page, document) of all page files."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.json").text(root, wholetext=True)
    path = F.input_file_name()
    number = F.regexp_extract(path, r"/page_(\d{4,})\.json$", 1)
    rows = files.select(F.regexp_extract(path, r"(.*)/[^/]+$", 1).alias("folder"), number.alias("p"), F.col("value").alias("document"))
    return rows.where("p <> ''").select("folder", F.col("p").cast("int").alias("page"), "document")


def _is_full(pages: str, expected: str):
    """Whether an array holds each of 1..expected once."""
    return F.when(F.col(expected) >= 1, F.sort_array(pages) == F.sequence(F.lit(1), F.col(expected))).otherwise(False)


def complete(states: DataFrame) -> DataFrame:
    """Runs that ended well with every page. Null fields make a run incomplete; one of no pages is none."""
    return states.where((F.col("status") == "completed") & _is_full("pages_saved", "expected_pages"))


def completed_runs(spark: SparkSession, root: str) -> DataFrame:
    """Complete runs whose files on disk are the pages of their state too, by start and id."""
    files = page_files(spark, root).select("folder", "page")
    return with_all_files(complete(runs(spark, root)), files, "folder").orderBy("started_at", "run_id")


def with_all_files(states: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Runs that have each of their expected pages among files (key, page), and no others."""
    on_disk = files.groupBy(key).agg(F.collect_set("page").alias("files"))
    return states.join(on_disk, key).where(_is_full("files", "expected_pages")).drop("files")


def latest_incomplete(states: DataFrame) -> DataFrame:
    """The backfill that was started last and did not end well; no row if there is none."""
    return states.where((F.col("mode") == "backfill") & F.col("status").isin("running", "failed")).orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def is_page(document: str) -> Column:
    """Whether a text is a page document: an object at payload.recenttracks."""
    shape = F.try_variant_get(F.try_parse_json(document), "$.payload.recenttracks", "variant")
    return F.coalesce(F.to_json(shape).startswith("{"), F.lit(False))


def pages_of(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(run_id, page, document) of the runs in ``wanted``; raises for a page that is no page document."""
    docs = page_files(spark, root).join(wanted.select("folder", "run_id"), "folder").select("run_id", "page", "document")
    bad = docs.where(~is_page("document")).select("run_id", "page").first()
    if bad:
        raise ContractError(f"run {bad.run_id}, page {bad.page}: not a page document")
    return docs


def latest_second(pages: DataFrame) -> DataFrame:
    """(watermark): the latest second of a completed record among pages (run_id, page, document), null if there is none;
    now-playing and unreadable ones do not count. Meant for pages of completed runs, so that a failed run cannot move it."""
    from ..plans.silver import flatten, read_tracks

    return read_tracks(flatten(pages)).where("coalesce(now, '') <> 'true'").agg(F.max("second").alias("watermark"))


def watermark(pages: DataFrame) -> int | None:
    return latest_second(pages).first()[0]
