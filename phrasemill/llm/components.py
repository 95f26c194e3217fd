"""Connected components of an edge table, by contraction to minimum neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.shared import counted, materialise, unsent


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (id, component): the smallest id reachable, for each id that has an edge.

    Each round hangs every node on its least neighbour if that is smaller (a partial aggregate, so a hub's edges shrink
    before the shuffle), shortens the chains by pointer jumping to their roots, and goes on with the edges between different
    roots only. Maps of many rows don't go through the driver. A root is the least node of its tree, and of two neighbouring trees one is hung on the other, so at least half
    of the trees go each round and the edge table shrinks. Every table is written to the shared folder. Self loops and repeated
    edges are allowed.
    """
    left = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not left.isEmpty():
        down = left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up"))
        up = unsent(*counted(down, "up"))
        while True:
            above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
            if up.join(above, "up", "left_semi").isEmpty():
                break
            up = unsent(*counted(up.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up")), "up"))
        maps.append((up, left))
        ends = left.join(up.withColumnRenamed("id", "a"), "a").select(F.col("up").alias("x"), "b")
        ends = ends.join(up.select(F.col("id").alias("b"), F.col("up").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y")).where("x <> y")
        left = materialise(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    first = maps[0][1]
    out = first.select(F.col("a").alias("id")).union(first.select(F.col("b").alias("id"))).distinct().withColumn("component", F.col("id"))
    for up, _ in maps:
        out = out.join(up.select(F.col("id").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    return unsent(*counted(out, "components"))
