"""Deterministic selection, splits and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanalign.functions.bytesops import keyed_hash


def keep_first(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sha256 of the first document of each text."""
    return docs.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256")).groupBy("sha256").agg(F.min(key).alias(key)).select(key, "sha256")


def hash_split(rows: DataFrame, key: str, group: str, seed: int, share: int = 5) -> DataFrame:
    """key, group, split: of each group the first part by hash rank, rounded up, is for calibration.

    The rank is found by counting: groups are cut into hash ranges, whose counts give each range's
    first rank, so that only one range has to be sorted by a task.
    """
    ranked = rows.withColumn("h", keyed_hash(F.lit(str(seed)), F.col(group), F.col(key).cast("string"))).withColumn("range", F.substring("h", 1, 2))
    sizes = ranked.groupBy(group, "range").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(group)
    sizes = sizes.withColumn("before", F.sum("c").over(whole.orderBy("range")) - F.col("c")).withColumn("n", F.sum("c").over(whole))
    own = F.row_number().over(Window.partitionBy(group, "range").orderBy("h", key))
    placed = ranked.withColumn("own", own).join(sizes.drop("c"), [group, "range"])
    first = F.col("before") + F.col("own") <= F.ceil(F.col("n") / share)
    return placed.select(key, group, F.when(first, "calibration").otherwise("test").alias("split"))


def lpt(groups: DataFrame, key: str, size: str, shards: int, most: int = 100_000) -> DataFrame:
    """key, size, shard: longest first to the least loaded shard, ties to the lower one.

    The rule is sequential, so the driver takes the groups, at most ``most``; more are refused
    rather than dealt by another rule.
    """
    import heapq

    rows = groups.orderBy(F.desc(size), key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups: deal by ranges instead")
    load = [(0, k) for k in range(shards)]
    out = []
    for r in rows:
        total, k = heapq.heappop(load)
        out.append((r[key], r[size], k))
        heapq.heappush(load, (total + r[size], k))
    return groups.sparkSession.createDataFrame(out, f"{key} {groups.schema[key].dataType.simpleString()}, {size} bigint, shard int")
