"""Matching of proposed boundaries with span edges, and precision, recall and F1 of the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_matches(pred: DataFrame, targets: DataFrame, keys=("file_id", "off")) -> DataFrame:
    """Distinct keys on both sides: one equi join, both sides summed to distinct keys first."""
    return pred.select(*keys).distinct().join(targets.select(*keys).distinct(), list(keys))


def one_to_one(predictions: str, targets: str, k: int) -> Column:
    """Number of pairs within k bytes, each offset in one pair at most, as many as possible.

    Both are sorted arrays of distinct offsets. In order, each prediction takes the smallest target
    within reach that is beyond the last one taken.
    """
    return F.expr(
        f"""aggregate({predictions}, struct(CAST(-1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS n),
          (a, p) -> transform(array(array_min(filter({targets}, t -> t > a.last AND t >= p - {k} AND t <= p + {k}))),
            m -> IF(m IS NULL, a, struct(m AS last, a.n + 1 AS n)))[0], a -> a.n)"""
    )


def counts_by_file(pred: DataFrame, targets: DataFrame, k: int, file: str = "file_id", offset: str = "off") -> DataFrame:
    """file, tp, fp, fn of one-to-one matching; files with rows on one side only count too."""
    p = pred.groupBy(file).agg(F.array_sort(F.collect_set(offset)).alias("p"))
    t = targets.groupBy(file).agg(F.array_sort(F.collect_set(offset)).alias("t"))
    none = F.array().cast("array<bigint>")
    both = p.join(t, file, "full_outer").select(file, F.coalesce("p", none).alias("p"), F.coalesce("t", none).alias("t"))
    tp = one_to_one("p", "t", k)
    return both.withColumn("tp", tp).select(file, "tp", (F.size("p") - F.col("tp")).alias("fp"), (F.size("t") - F.col("tp")).alias("fn"))


def zero_safe(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """precision, recall and f1 that are 0 where nothing was there."""
    def ratio(a, b):
        return F.expr(f"coalesce(try_divide(CAST({a} AS DOUBLE), {b}), 0D)")

    return [ratio(tp, f"({tp} + {fp})").alias("precision"), ratio(tp, f"({tp} + {fn})").alias("recall"), ratio(f"2 * {tp}", f"(2 * {tp} + {fp} + {fn})").alias("f1")]


def within(pred: DataFrame, targets: DataFrame, k: int, file: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(predictions that have a target within k, targets that have a prediction within k).

    Offsets are dealt into cells of k + 1 bytes; a partner within k is in the same or a next cell,
    so the band becomes an equi join on (file, cell) with three rows for one side.
    """
    def celled(df):
        return df.select(file, "off").distinct().withColumn("cell", F.floor(F.col("off") / (k + 1)))

    def near(a, b):
        spread = b.select(file, F.col("off").alias("other"), F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell"))
        return a.join(spread, [file, "cell"]).where(F.abs(F.col("off") - F.col("other")) <= k).select(file, "off").distinct()

    p, t = celled(pred), celled(targets)
    return near(p, t), near(t, p)


def outermost(nodes: DataFrame, edge: str, order: list[Column], file: str = "file_id") -> DataFrame:
    """The node that owns each offset: the first by ``order`` of those with this edge there."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(file, edge).orderBy(*order))
    return nodes.withColumn("rank__", rank).where("rank__ = 1").drop("rank__")
