"""Connected components as joins: least labels of neighbours and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import settle


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of an edge (a, b); component is the smallest id reachable.

    Every pass takes the least label among neighbours and then follows labels
    one step further, so paths shorten by a factor; it ends when no label moves.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a")).filter("id <> to")
    both = settle(both.distinct(), "graph")
    labels = settle(both.groupBy("id").agg(F.min("to").alias("least")).select("id", F.least("id", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("least"))
        moved = labels.join(near, "id").select("id", "component", F.least("component", "least").alias("next"))
        onward = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        moved = settle(moved.join(onward, "next", "left").select("id", "component", F.least("next", F.coalesce("beyond", "next")).alias("next")), "labels")
        done = moved.filter("component <> next").isEmpty()
        labels = moved.select("id", F.col("next").alias("component"))
        if done:
            return labels
