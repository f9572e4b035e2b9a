"""Connected components of an edge table, without any collection on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import Workspace

EDGE = "u bigint, v bigint"


def components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without edges are absent.

    Alternating large and small stars: each round hangs a node's neighbours on the smallest one, so
    that the number of rounds is logarithmic. A node of very many edges is only ever summed to its
    minimum. Each round is written to the shared folder, which ends its lineage.
    """
    def directed(e):
        return e.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")

    now = directed(edges)
    path = work.write(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_done(work.read(path, schema=EDGE)):
        now = work.read(path, schema=EDGE)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: the larger neighbours hang on the smallest
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large_path = work.write(large)
        large = work.read(large_path, schema=EDGE)
        # small star: the smaller neighbours and the node itself hang on the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        new_path = work.write(small.where("u <> v").distinct())
        work.drop(path, large_path)
        path = new_path
    return work.read(path, schema=EDGE).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _is_done(now: DataFrame) -> bool:
    """Whether every node hangs on one root: none has two edges down, and no edge's foot has one."""
    ends = now.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("foot")).unionAll(now.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("foot").alias("foot"))
    return seen.where("down > 1 OR down > 0 AND foot > 0").isEmpty()
