"""Connected components of a link table, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``, the component being its smallest node.

    Each round sends every node to its smallest neighbour (or itself), follows these steps to their ends by doubling, and keeps what
    links remain between the ends; all rounds' steps are then followed from the first to the last. An end is smaller than all its
    neighbours, so that each round leaves half of a component's nodes at most: rounds grow with the logarithm of its size, and
    the doublings of a round with the logarithm of its longest walk.
    Each is an aggregation with map-side partial results or a join whose hot keys Spark can split.
    Rounds end in tables of known size: a checkpoint keeps the size that the planner guessed, which joins of a round with itself square, until the driver's
    memory is full of its digits.
    """
    edges = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    chosen: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = ends(written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))))
        chosen.append(to)
        left = edges.join(to.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("x"), "b")
        moved = left.join(to.withColumnRenamed("node", "b"), "b").select("x", F.col("to").alias("y"))
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
    if not chosen:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    found = chosen[0].select("node", F.col("to").alias("component"))
    for to in chosen[1:]:
        step = to.select(F.col("node").alias("component"), "to")
        found = found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return found


def ends(to: DataFrame) -> DataFrame:
    """Where the steps ``node, to`` lead at last; each ``to`` is a node as well, and ends lead to themselves."""
    while True:
        after = to.select(F.col("node").alias("to"), F.col("to").alias("then"))
        jumped = to.join(after, "to").select("node", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved"))
        if jumped.where("moved").isEmpty():
            return to
        to = written(jumped.drop("moved"))
