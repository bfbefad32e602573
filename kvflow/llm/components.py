"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.llm.common import spread, stored, written
from kvflow.sources.paths import delete_path


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); nodes of one component share their root.

    Each round points every node at its least neighbour or itself and joins nodes that point alike;
    the links that are left run between the joined nodes. Groups shrink at least by half a round,
    tables are shuffled by node with partial aggregates unless they are small, and every round is written.
    """
    edges = links.select("a", "b").filter("a <> b")
    maps: list[DataFrame] = []
    spark, last = links.sparkSession, None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("to")
        )
        points = stored(points, "component-points")
        if points.isEmpty():
            break
        points = spread(points)
        maps.append(points)
        left = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        # a node keeps a link to the one it points at, which itself may point further
        further = points.select(F.col("node").alias("a"), F.col("to").alias("b")).filter("a <> b")
        edges, path = written(
            edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            .union(further.join(right, "b").select(F.col("b").alias("a"), F.col("y").alias("b")))
            .filter("a <> b").distinct(),
            "component-edges",
        )
        if last:
            delete_path(spark, last)
        last = path
    if last:
        delete_path(spark, last)
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = maps[0].select("node", F.col("to").alias("root"))
    for points in maps[1:]:
        step = points.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(out, "components")
