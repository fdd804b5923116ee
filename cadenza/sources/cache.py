"""Provider answers kept as files, and the same files as a table."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNIT
from ..schemas import CACHE, columns
from .landing import now, read_json, write_json

STATUS = ("success", "not_found", "error")


class ResponseCache:
    """One JSON document for each (provider, entity type, request), named by the hash of the three. A damaged document or one
    with an unknown status is a miss."""

    def __init__(self, root: str | Path) -> None:
        self.root = Path(root)

    def path(self, provider: str, entity_type: str, identity: str) -> Path:
        name = hashlib.sha256(UNIT.join((provider, entity_type, identity)).encode()).hexdigest()
        return self.root / provider / f"{entity_type}s" / f"{name}.json"

    def load(self, provider: str, entity_type: str, identity: str) -> dict | None:
        doc = read_json(self.path(provider, entity_type, identity))
        return doc if isinstance(doc, dict) and doc.get("status") in STATUS else None

    def store(self, provider: str, entity_type: str, identity: str, status: str, response: Any = None, error: str | None = None) -> dict:
        doc = {"provider": provider, "entity_type": entity_type, "request_identity": identity, "retrieved_at": now(), "status": status, "response": response}
        if error:
            doc["error"] = error
        write_json(self.path(provider, entity_type, identity), doc)
        return doc


    def frame(self, spark: SparkSession, requests: list[tuple[str, str, str]]) -> DataFrame:
        """The documents of some requests as :func:`cached_responses` gives them all."""
        docs = [d for r in requests if (d := self.load(*r))]
        rows = [tuple(json.dumps(d.get(n), ensure_ascii=False) if n == "response" and d.get(n) is not None else d.get(n) for n, _ in columns(CACHE)) for d in docs]
        return spark.createDataFrame(rows, CACHE)


def cached_responses(spark: SparkSession, root: str) -> DataFrame:
    """All documents under ``root`` as a table; ``response`` is JSON text. Documents that would be a miss are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    doc = F.try_parse_json("value")
    get = lambda p: F.try_variant_get(doc, f"$.{p}", "string")
    response = F.to_json(F.try_variant_get(doc, "$.response", "variant"))
    names = [x.split(" ")[0] for x in CACHE.split(", ")]
    return files.select(*[(response if n == "response" else get(n)).alias(n) for n in names]).where(F.col("status").isin(*STATUS))
