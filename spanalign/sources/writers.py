"""Sinks. Spark's commit protocol makes each write visible as a whole or not at all."""

from __future__ import annotations

import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.operators.validate import bag_difference
from spanalign.sources.readers import bucket


def table(df: DataFrame, path: str, exclusive: bool = False) -> None:
    """Parquet; ``exclusive`` refuses to replace what is there."""
    df.write.mode("errorifexists" if exclusive else "overwrite").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys and without fields that are null."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def csv_union(frames: list[DataFrame], path: str) -> None:
    """One CSV of several results: the header is the union of their columns, in order of appearance."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).write.mode("overwrite").option("header", "true").csv(path)


def dual(df: DataFrame, path: str, name: str) -> None:
    """The same rows as Parquet and CSV, marked as preliminary."""
    marked = df.withColumn("preliminary", F.lit(True))
    marked.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    marked.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}.csv")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def if_changed(df: DataFrame, path: str) -> str:
    """Writes unless the same bag of rows is there: written, skipped or rewrote."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        table(df, path)
        return "written"
    there = spark.read.parquet(path)
    if there.dtypes == df.dtypes:
        diff = bag_difference(there, df).first()
        if not diff["n_missing"] and not diff["n_extra"]:
            return "skipped"
    fresh = f"{path.rstrip('/')}.new"
    table(df, fresh)
    table(spark.read.schema(df.schema).parquet(fresh), path)
    fpath = spark._jvm.org.apache.hadoop.fs.Path(fresh)
    fpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fpath, True)
    return "rewrote"


def register(df: DataFrame, path: str, key: str, fixed: list[str]) -> DataFrame:
    """Appends to a registry and gives the conflicts: keys that are there with other fixed columns."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        there = spark.read.parquet(path).select(key, F.struct(*fixed).alias("before")).distinct()
        conflicts = df.join(there, key).where(~F.struct(*fixed).eqNullSafe(F.col("before"))).select(key, *fixed)
        if not conflicts.isEmpty():
            return conflicts
    df.write.mode("append").parquet(path)
    return df.select(key, *fixed).limit(0)


def fingerprint(df: DataFrame) -> str:
    """A hash of the bag of rows that no order or partitioning changes."""
    h = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.expr("bit_xor(h)").alias("x")).first()
    return f"{h['n']}-{h['s']}-{h['x']}"


def indexed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Parquet in folders by the key's bucket, sorted by key inside, so that a key is found without reading the rest."""
    df.withColumn("bucket", bucket(F.col(key), buckets)).repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def upsert(df: DataFrame, path: str, deleted: bool = False) -> None:
    """Appends rows that readers.latest prefers to older ones of their key; no reader waits and no lock is needed.

    Writers at the same nanosecond are told apart by a random number; clocks of several drivers should agree.
    """
    stamped = df.withColumns({"version__": F.lit(time.time_ns()), "writer__": F.lit(uuid.uuid4().hex), "deleted__": F.lit(deleted)})
    stamped.write.mode("append").parquet(path)


def register_analysis(df: DataFrame, path: str, inputs: DataFrame, code: str) -> None:
    """Upserts analyses, with what they came from: a fingerprint of their inputs and the code's version."""
    upsert(df.withColumns({"inputs": F.lit(fingerprint(inputs)), "code": F.lit(code)}), path)


_OWN_DIR: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """df, written once to a new folder under spark.checkpoint.dir (where that is unset, a local one) and read back.

    What reads it more than once makes it once, and its lineage ends here.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spanalign-"))
        base = _OWN_DIR[0]
    path = f"{base.rstrip('/')}/k-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
