"""Landing pages of a paged source: backfill, resume, incremental."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.http import PagedSource
from ..sources.landing import STATE, completed_runs, latest_incomplete, new_run, now, pages_of, read_json, run_folder, runs, save_page, saved_pages, watermark, write_json


def since(spark: SparkSession, root: str) -> int | None:
    """The second after which an incremental run asks: the latest event of completed runs, or None for everything."""
    if not any(Path(root).glob("*/run_*/" + STATE)):
        return None
    done = completed_runs(spark, root)
    return None if done.isEmpty() else watermark(pages_of(spark, root, done))


def _resumable(spark: SparkSession, root: str) -> tuple[Path, dict] | None:
    if not any(Path(root).glob("*/run_*/" + STATE)):
        return None
    row = latest_incomplete(runs(spark, root)).first()
    if row is None:
        return None
    folder = run_folder(Path(root), row.run_id)
    state = read_json(folder / STATE)
    return (folder, state) if isinstance(state, dict) else None


def ingest(spark: SparkSession, source: PagedSource, root: str, backfill: bool = False, resume: bool = False, max_pages: int | None = None, name: str = "provider") -> dict:
    """One run: every page is saved and noted in the run's state as it comes. Returns the final state.

    ``resume`` continues the latest backfill that did not end well with its missing pages; if none is missing the run is
    completed as it is. A run cut short by ``max_pages`` has failed. An error marks the run failed and is raised again.
    """
    if resume and not backfill:
        raise ValueError("only a backfill can be resumed")
    if max_pages is not None and max_pages < 1:
        raise ValueError("max_pages must be at least 1")
    start = None if backfill else since(spark, root)
    folder, state = (_resumable(spark, root) if resume else None) or new_run(Path(root), "backfill" if backfill else "incremental")
    state |= {"status": "running", "failure_type": None}
    have = set(saved_pages(folder))
    asked = 0
    try:
        expected = state.get("expected_pages")
        while not (expected and set(range(1, expected + 1)) <= have):
            page = min(set(range(1, len(have) + 2)) - have)
            if max_pages is not None and asked >= max_pages:
                state |= {"status": "failed", "failure_type": "MaxPagesLimit"}
                break
            _, expected, body = next(source.pages(page, since=start))
            asked += 1
            save_page(folder, page, body, name, source.method)
            have.add(page)
            state |= {"pages_saved": sorted(have), "expected_pages": expected}
            write_json(folder / STATE, state)
            if not body["recenttracks"]["track"]:
                state["expected_pages"] = expected = min(expected, max(have))
        else:
            state |= {"status": "completed", "completed_at": now(), "pages_saved": sorted(have)}
    except Exception as e:
        state |= {"status": "failed", "failure_type": type(e).__name__}
        raise
    finally:
        write_json(folder / STATE, state)
    return state
