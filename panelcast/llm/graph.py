"""Connected components of an edge table, entirely as joins over stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.sources.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a long, b long).

    Each round hangs every node below its smallest neighbour and moves the edges up to those parents, which at least
    halves chains. Edges inside a node vanish, so the table shrinks; rounds are stored, no lineage builds up.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("parent")).withColumnRenamed("a", "child"), "parents")
        labels = stage(
            labels.join(parents, labels["component"] == parents["child"], "left").select("node", F.coalesce("parent", "component").alias("component")), "labels"
        )
        up = edges.join(parents.select(F.col("child").alias("a"), F.col("parent").alias("pa")), "a").join(parents.select(F.col("child").alias("b"), F.col("parent").alias("pb")), "b")
        up = up.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = stage(up.distinct(), "edges")
    return labels
