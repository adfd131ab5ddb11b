"""Connected components of an edge table, by contraction.

Each round a vertex takes the smallest vertex next to it, then what that one
took, and the edges are drawn between what their ends took; edges inside one
vertex vanish. A star is done in one round or two, a chain loses half its
vertices in each. Edges and labels are written tables; joins are on one vertex
with both sides straight from an exchange, so the edges of a hub are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (id, label): the smallest vertex id reachable, for
    every vertex that has an edge to another."""
    edges = stage(_between(edges), "edges")
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other"))
        ends = ends.union(edges.select(F.col("b"), F.col("a")))
        near = ends.groupBy("id").agg(F.min("other").alias("other"))
        near = stage(near.select("id", F.least("id", "other").alias("label")), "near")
        further = near.select(F.col("id").alias("label"), F.col("label").alias("further"))
        taken = stage(near.join(further, "label").select("id", F.col("further").alias("label")), "taken")
        of_a, of_b = taken.toDF("a", "to_a"), taken.toDF("b", "to_b")
        drawn = edges.join(of_a, "a").join(of_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = stage(_between(drawn), "edges")
        if labels is None:
            labels = taken
        else:
            now = taken.select(F.col("id").alias("label"), F.col("label").alias("now"))
            moved = labels.join(now, "label", "left").select("id", F.coalesce("now", "label").alias("label"))
            labels = stage(moved, "labels")
        if edges.isEmpty():
            return labels


def _between(edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.where("a <> b").distinct()
