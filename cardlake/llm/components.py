"""Connected components of a graph of 64-bit ids, by least labels and pointer jumping.

Every round is a join and an aggregation over the edges, written to the shared folder; only the number of
changed labels comes to the driver. A star's hub is a skewed join key, which adaptive execution splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table


def components(edges: DataFrame, *, rounds: int = 64) -> DataFrame:
    """(node, label): for each node of edges (a, b) the least node that it is connected with."""
    a, b = F.col("a"), F.col("b")
    both = table(
        edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().select(
            F.explode(F.array(F.struct("a", "b"), F.struct(b.alias("a"), a.alias("b")))).alias("e")
        ).select("e.a", "e.b"),
        "edges",
    )
    labels = table(both.groupBy("a").agg(F.min("b").alias("m")).select(a.alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(labels, a == F.col("node")).groupBy("b").agg(F.min("label").alias("m"))
        near = labels.join(seen, F.col("node") == b, "left").select("node", F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("to"))
        new = table(near.join(jump, F.col("label") == F.col("at"), "left").select("node", F.least("label", "to").alias("label")), "labels")
        old = labels.select(F.col("node").alias("n"), F.col("label").alias("was"))
        changed = new.join(old, F.col("node") == F.col("n")).where(F.col("label") != F.col("was")).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
