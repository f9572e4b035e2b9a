"""K-d tree sharding by bytes.

Groups of equal texts are points in metadata space, weighted by their bytes. A node is split along
the dimension in which its points spread widest, at the weighted median, until a leaf has the
target bytes. All nodes of a level are split together: the median is found by histograms of a fixed
number of bins that close in on it, so the driver sees bins only, never points. Nodes are rows of a
table, at most one for each shard.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import Workspace, table

BINS = 1024
#: Bins of all nodes together that the driver sees at once.
MOST_BINS = 1 << 17
#: Nodes that travel to every task as a table; more are met by a merge join.
SENT_NODES = 200_000
#: Parts into which equal texts are dealt.
SALT = 64
#: A cut may miss its weight by this part of a leaf.
TOLERANCE = 0.0005
#: Equal texts stay together up to this part of a leaf; a larger group is split by rows.
WHOLE = 0.02
#: Rows of a shard are numbered in this many independent parts.
PARTS = 64

DIMENSIONS = ("size", "source", "lang", "doc_id")


def _points(docs: DataFrame, key: str, text: str, work: Workspace) -> DataFrame:
    """One narrow row for each document: key, size, crc, group and the group's coordinates in 0..1e6."""
    t = F.coalesce(F.col(text), F.lit(""))
    have = {c.lower() for c in docs.columns}

    def spread(c):
        return F.pmod(F.xxhash64(c), F.lit(1_000_000)) if c in have else F.lit(0).cast("long")

    rows = docs.select(
        F.col(key).alias("key"), (F.octet_length(t).cast("long") + 1).alias("bytes"), F.crc32(t.cast("binary")).alias("crc"),
        F.xxhash64(t).alias("grp"), spread("source").alias("s"), spread("lang").alias("l"),
    )
    rows = work.keep(rows).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)))
    least = [F.min(c).alias(c) for c in ("size", "first", "s", "l")]
    of = rows.groupBy("grp", "salt").agg(F.sum("bytes").alias("weight"), F.min("bytes").alias("size"), F.min("key").alias("first"), F.min("s").alias("s"), F.min("l").alias("l")).groupBy("grp")
    of = of.agg(F.sum("weight").alias("weight"), *least, F.collect_list("salt").alias("salts")).select("grp", "weight", "size", "first", "s", "l", F.explode("salts").alias("salt"))
    return rows.select("key", "bytes", "crc", "grp", "salt").join(of, ["grp", "salt"]).drop("salt")


def _node_table(spark, rows: list, schema: str) -> DataFrame:
    """A table of at most as many rows as there are shards."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= SENT_NODES else out.hint("merge")


def assign(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot, text_group of every row.

    Give the number of shards or the bytes that a leaf is to have. Equal texts share a shard unless
    together they pass WHOLE of a leaf. Null texts have the size 1; null keys come first;
    repeated rows are placed each. Other columns but source and lang are ignored. No documents: no
    rows, no shards.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    points = _points(docs, key, text, work)
    total = points.agg(F.sum("bytes")).first()[0] or 0
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    leaf = max(1.0, total / shards)
    limit = TOLERANCE * leaf
    large = F.col("weight") > WHOLE * leaf
    # order inside equal coordinates: the group, and inside a group too large to stay whole the row
    tie = F.xxhash64(F.col("grp"), F.when(large, F.xxhash64("key", "grp")).otherwise(F.lit(0)))
    top = points.agg(F.max(F.coalesce("first", F.lit(0))), F.min(F.coalesce("first", F.lit(0)))).first()
    low, span = top[1] or 0, max(1, (top[0] or 0) - (top[1] or 0))
    dims = {
        "size": F.least(F.lit(999_999), (F.log2(F.col("size").cast("double")) * 30_000).cast("long")),
        "source": F.col("s"),
        "lang": F.col("l"),
        "doc_id": ((F.coalesce("first", F.lit(low)).cast("double") - low) / span * 999_999).cast("long"),
    }
    placed = work.keep(points.select("key", "bytes", "crc", "grp", F.shiftrightunsigned(tie, 24).alias("tie"), *(c.alias(f"d_{d}") for d, c in dims.items()), F.lit(0).alias("node")))
    schema = placed.schema
    nodes = {0: (0, shards)}  # node -> its first shard and number of shards
    next_node = 1
    while any(n > 1 for _, n in nodes.values()):
        split = [k for k, (_, n) in nodes.items() if n > 1]
        inside = placed.join(_node_table(spark, [(k,) for k in split], "node int"), "node", "left_semi")
        ranges = {r["node"]: r for r in inside.groupBy("node").agg(F.sum("bytes").alias("w"), *(F.min(f"d_{d}").alias(f"lo_{d}") for d in DIMENSIONS), *(F.max(f"d_{d}").alias(f"hi_{d}") for d in DIMENSIONS)).collect()}
        split = [k for k in split if k in ranges]
        widest = {k: max(range(len(DIMENSIONS)), key=lambda d, r=ranges[k]: r[f"hi_{DIMENSIONS[d]}"] - r[f"lo_{DIMENSIONS[d]}"]) for k in split}
        # the coordinate and the tie in one number: 20 bits and 40 bits
        chosen = F.element_at(F.array(*(F.col(f"d_{d}") for d in DIMENSIONS)), F.col("dim") + 1)
        at = chosen * F.lit(1 << 40) + F.col("tie")
        dims_of = _node_table(spark, [(k, widest[k]) for k in split], "node int, dim int")
        coded = work.keep(inside.join(dims_of, "node").select("node", at.alias("at"), "bytes"))
        goal = {k: ranges[k]["w"] * (nodes[k][1] // 2) / nodes[k][1] for k in split}
        bounds = {k: (0, 1 << 60, 0) for k in split}  # lowest and highest place of the cut, weight below
        cuts: dict[int, int] = {}
        while bounds:
            bins = max(2, min(BINS, MOST_BINS // len(bounds)))
            step = {k: max(1, -(-(hi - lo) // bins)) for k, (lo, hi, _) in bounds.items()}
            looked = _node_table(spark, [(k, lo, hi, step[k]) for k, (lo, hi, _) in bounds.items()], "node int, lo bigint, hi bigint, step bigint")
            binned = coded.join(looked, "node").where("at >= lo AND at < hi").withColumn("bin", F.expr("(at - lo) div step"))
            by: dict[int, dict[int, int]] = {}
            for r in binned.groupBy("node", "bin").agg(F.sum("bytes").alias("w")).collect():
                by.setdefault(r["node"], {})[r["bin"]] = r["w"]
            for k in list(bounds):
                lo, hi, below = bounds.pop(k)
                for b, w in sorted(by.get(k, {}).items()):
                    if below + w >= goal[k]:
                        start = lo + b * step[k]
                        if step[k] == 1 or min(below + w - goal[k], goal[k] - below) <= limit:
                            cuts[k] = start if goal[k] - below < below + w - goal[k] else start + step[k]
                        else:
                            bounds[k] = (start, start + step[k], below)
                        break
                    below += w
                else:
                    cuts[k] = hi
        right = {}
        for k in split:
            first, n = nodes.pop(k)
            nodes[next_node], nodes[next_node + 1] = (first, n // 2), (first + n // 2, n - n // 2)
            right[k] = next_node
            next_node += 2
        for k in [k for k, (_, n) in nodes.items() if n > 1 and k not in right.values() and k - 1 not in right.values()]:
            nodes.pop(k)  # a node without points
        moves = _node_table(spark, [(k, widest[k], cuts[k], right[k]) for k in split], "node int, dim int, cut bigint, first int")
        new = F.when(F.col("first").isNull(), F.col("node")).otherwise(F.col("first") + F.when(at < F.col("cut"), 0).otherwise(1))
        placed = work.read(work.write(placed.join(moves, "node", "left").withColumn("node", new.cast("int")).select(*schema.names)), schema=schema)
    shard = _node_table(spark, [(k, first) for k, (first, _) in nodes.items()], "node int, shard int")
    rows = placed.join(shard, "node", "left").select("key", "bytes", "crc", "grp", F.coalesce("shard", F.lit(0)).alias("shard"), F.expr(f"pmod(xxhash64(key, grp), {PARTS})").alias("part"))
    return _numbered(rows, work).select(F.col("key").alias(key), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), "shard", "slot", F.col("grp").alias("text_group"))


def _numbered(rows: DataFrame, work: Workspace) -> DataFrame:
    """rows with slot, gapless from 0 in each shard: parts are counted, then numbered by themselves."""
    from pyspark.sql import Window

    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("part")) - F.col("c")
    starts = counts.select("shard", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "grp")) - 1
    return rows.withColumn("own", own).join(starts, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("own"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
