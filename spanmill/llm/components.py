"""Connected components of a large edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.session import written


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents (each at most its node) until every node has its root."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        jumped = written(parents.join(above, "parent").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")), "parents")
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every end of ``edges`` (a, b): the least node of its component.

    Each round gives every node the least node within two steps and joins the nodes of one
    root into one, so at least half of the nodes go and rounds grow with the logarithm.
    Only emptiness tests reach the driver. Tables are written, so that joins deal both sides
    anew and a node with very many edges can be split.
    """
    current = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    levels: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).withColumn("least", F.least("node", "least")), "nearest")
        beyond = (
            both.join(near.select(F.col("node").alias("b"), F.col("least").alias("beyond")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("beyond").alias("parent"))
        )
        parents = _roots(written(beyond.withColumn("parent", F.least("node", "parent")), "parents"))
        levels.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("a2"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("b2"))
        moved = current.join(left, "a").join(right, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        current = written(moved.filter("a <> b").distinct(), "edges")
    if not levels:
        return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = levels[0].withColumnRenamed("parent", "label")
    for level in levels[1:]:
        above = level.select(F.col("node").alias("label"), F.col("parent").alias("higher"))
        labels = labels.join(above, "label", "left").select("node", F.coalesce("higher", "label").alias("label"))
    return written(labels, "labels")
