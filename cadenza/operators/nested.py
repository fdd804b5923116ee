"""Nested JSON into related flat tables, by Dewey labels.

Every value under a key is read as a list: a lone value is element 0. So a node's label has the same number of parts at
one schema path, whether the source wrote an object or an array: each member step adds the ordinal of the key in its
object and the ordinal of the element. Truncating a label by two parts gives the parent's label; nodes of one schema path
make one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "doc_key string, path string, label array<int>, kind string, value string"


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in text) else text


def walk(root: object) -> Iterator[tuple[str, tuple[int, ...], str, str | None]]:
    """(schema path, label, kind, scalar value) of every node of a parsed document, parents first."""
    stack: list[tuple[str, tuple[int, ...], object]] = [("", (), root)]
    while stack:
        path, label, x = stack.pop()
        if isinstance(x, dict):
            yield path, label, "object", None
            below = []
            for k, (key, value) in enumerate(x.items()):
                inner = f"{path}/{_clean(key).replace('~', '~0').replace('/', '~1')}"
                elements = value if isinstance(value, list) else [value]
                below += [(inner, (*label, k, i), v) for i, v in enumerate(elements)]
            stack += reversed(below)
        elif isinstance(x, list):  # an array in an array: one more pair of parts
            yield path, label, "array", None
            stack += reversed([(f"{path}/[]", (*label, 0, i), v) for i, v in enumerate(x)])
        elif x is None:
            yield path, label, "null", None
        elif isinstance(x, bool):
            yield path, label, "boolean", "true" if x else "false"
        elif isinstance(x, str):
            yield path, label, "string", _clean(x)
        else:
            yield path, label, "number", repr(x)


def _explode(paths: frozenset[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b.doc_key, b.doc, strict=True):
                try:
                    root = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                rows += [(key, p, list(lab), k, v) for p, lab, k, v in walk(root) if paths is None or p in paths]
            yield pd.DataFrame(rows, columns=["doc_key", "path", "label", "kind", "value"])

    return run


def dewey_nodes(df: DataFrame, key: str, doc: str, paths: list[str] | None = None) -> DataFrame:
    """(doc_key, path, label, kind, value): one row for each node of the JSON text in ``doc``.

    ``paths`` keeps only nodes at these schema paths ("/pages/metadata/page"), applied before rows leave the parser.
    A text that is null or not one complete JSON value gives no rows; a key that stands twice in an object keeps its last
    value; lone surrogates become "?". Repeated rows give repeated nodes. No shuffle.
    """
    texts = df.select(F.col(key).cast("string").alias("doc_key"), F.col(doc).alias("doc")).where("doc is not null")
    return texts.mapInPandas(_explode(frozenset(paths) if paths is not None else None), NODES)


def parent_label(label: str = "label", up: int = 1):
    """The label of the ancestor ``up`` member steps above."""
    return F.slice(F.col(label), 1, F.size(label) - 2 * up)


def flat_table(nodes: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """The table of the objects at schema path ``path``: (doc_key, label, parent_label, <fields>).

    ``fields`` maps an output column to a member's path below ``path``; each takes its first scalar value. Objects
    without any of the members stay, with nulls. Labels join a table with its parent's.
    """
    depth = path.count("/")
    at = {f"{path}/{member}": column for column, member in fields.items()}
    kept = nodes.where(F.col("path").isin(path, *at))
    owner = F.slice("label", 1, 2 * depth)
    own = kept.withColumn("full", F.col("label")).withColumn("label", F.when(F.col("path") == path, F.col("label")).otherwise(owner))
    first = [
        F.min_by(F.when(F.col("path") == p, F.col("value")), F.when((F.col("path") == p) & F.col("value").isNotNull(), F.col("full"))).alias(c)
        for p, c in at.items()
    ]
    return (
        own.groupBy("doc_key", "label")
        .agg(F.max((F.col("path") == path) & (F.col("kind") == "object")).alias("there"), *first)
        .where("there")
        .withColumn("parent_label", parent_label())
        .select("doc_key", "label", "parent_label", *fields)
    )
