"""Connected components by label spreading; every round is a written table, nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for each endpoint of ``edges`` (a, b): the least id reachable.

    Each round takes the least label of the neighbours and then the label of that label, so a path of n links needs about
    log n rounds. A hub's labels are combined on the map side before they are shuffled. Nulls in a or b are ignored.
    """
    e = edges.where("a is not null and b is not null")
    both = materialise(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("l")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        near = labels.join(seen, "v").select("v", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("l").alias("k"))
        new = near.join(jump, "m").select("v", F.least("m", "k").alias("n"), (F.least("m", "k") < F.col("l")).alias("moved"))
        new = materialise(new, "labels")
        done = new.where("moved").isEmpty()
        discard(labels)
        labels = new.select("v", F.col("n").alias("l"))
        if done:
            discard(both)
            return labels.select("v", F.col("l").alias("component"))
