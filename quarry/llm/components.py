"""Connected components by contraction, all of it in tables.

Each turn puts the nodes in a new random order, by a hash of node and turn. A
node takes the first one of its neighbourhood, itself included; links between
nodes that took the same one vanish and the others are drawn between what was
taken. Whatever the nodes are called and however the links lie, about half of
those that still have links are taken by none and go: a group around one node
is gone after a turn or two, a chain of n after some log2(n) turns, sorted or
not. A fixed order would follow a sorted chain link by link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Tables


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """``links``: u, v. Gives node, label for every node with a link; the label is one of the nodes of its component.

    All that is joined is written before, so Spark can split a node with very
    many links. The tables of a turn go when the next one has been written."""
    tables = tables or Tables(links.sparkSession)
    edges = tables.write(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    taken, turn = None, 0
    while edges.take(1):
        place = lambda node: F.xxhash64(F.lit(turn), node)  # noqa: E731, B023
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = ends.groupBy("u").agg(F.min_by("v", place(F.col("v"))).alias("m"))
        before: Column = place(F.col("m")) < place(F.col("u"))
        chosen = tables.write(first.select("u", F.when(before, F.col("m")).otherwise(F.col("u")).alias("m")), "chosen")
        by_v = chosen.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        drawn = edges.join(chosen, "u").join(by_v, "v").where("m <> mv")
        left = tables.write(drawn.select(F.least("m", "mv").alias("u"), F.greatest("m", "mv").alias("v")).distinct(), "edges")
        if taken is None:
            labels = tables.write(chosen.select(F.col("u").alias("node"), F.col("m").alias("label")), "labels")
        else:
            onward = chosen.select(F.col("u").alias("label"), "m")
            labels = tables.write(taken.join(onward, "label", "left").select("node", F.coalesce("m", "label").alias("label")), "labels")
        tables.remove(edges, chosen, taken)
        edges, taken, turn = left, labels, turn + 1
    if taken is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    tables.remove(edges)
    return taken
