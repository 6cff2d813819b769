"""Connected components of a link table by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a long, b long); equal roots are one component.

    Each round gives every node its smallest neighbour as parent, follows parents JUMPS times,
    and replaces links by those between the results, until none is left. A node with a link to
    a smaller one always moves, so links vanish in a number of rounds logarithmic in a
    component's size. Every round is written to the shared folder.
    """
    edges = materialize(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("parent"))
        parents = materialize(parents, "parents")
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        for _ in range(JUMPS):
            parents = parents.join(up, "parent").select("node", F.col("above").alias("parent"))
        parents = materialize(parents, "parents")
        names = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"to_{c}"))  # noqa: E731, B023
        moved = edges.join(names("a"), "a").join(names("b"), "b").where(F.col("to_a") != F.col("to_b"))
        edges = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        roots = materialize(
            roots.join(parents.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots"
        )
    return roots


JUMPS = 3
