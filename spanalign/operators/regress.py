"""Least squares from moments: the cluster sums products, the driver solves a small system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(name: str) -> Column:
    """A column by its whole name: names of levels may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def moments(df: DataFrame, columns: list[str], outcome: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and n in one aggregation."""
    k = len(columns)
    sums = [F.sum(_column(a) * _column(b)).alias(f"m{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    sums += [F.sum(_column(a) * _column(outcome)).alias(f"y{i}") for i, a in enumerate(columns)]
    r = df.agg(F.count("*").alias("n"), *sums).first()
    xx = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)
    return xx, np.array([r[f"y{i}"] or 0.0 for i in range(k)], float), r["n"]


def ols(df: DataFrame, outcome: str, columns: list[str], cluster: str, absorbed: bool = False) -> list[dict]:
    """Coefficients with cluster-robust standard errors (CR1) and normal 95 % intervals.

    ``absorbed``: the columns were demeaned within clusters, whose means count as parameters too.
    """
    xx, xy, n = moments(df, columns, outcome)
    bread = np.linalg.pinv(xx)
    beta = bread @ xy
    resid = F.col(outcome) - sum((F.lit(float(b)) * _column(c) for b, c in zip(beta, columns, strict=True)), F.lit(0.0))
    scored = df.withColumn("e__", resid).groupBy(cluster).agg(*(F.sum(_column(c) * F.col("e__")).alias(c) for c in columns))
    meat, _, groups = moments(scored.withColumn("one__", F.lit(1.0)), columns, "one__")
    k = len(columns) + (groups if absorbed else 0)
    scale = groups / max(1, groups - 1) * (n - 1) / max(1, n - k)
    se = np.sqrt(np.maximum(0.0, np.diag(bread @ meat @ bread) * scale))
    return [{"term": c, "estimate": float(b), "se": float(s), "low": float(b - 1.959963984540054 * s), "high": float(b + 1.959963984540054 * s), "n": int(n), "clusters": int(groups), "rank": int(np.linalg.matrix_rank(xx))} for c, b, s in zip(columns, beta, se, strict=True)]


def demeaned(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """Columns less their cluster means: means are summed by cluster and joined back."""
    means = df.groupBy(cluster).agg(*(F.avg(c).alias(f"mean_{c}") for c in columns))
    return df.join(means, cluster).select(cluster, *((F.col(c) - F.col(f"mean_{c}")).alias(c) for c in columns))


def with_levels(df: DataFrame, column: str, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each level of ``column`` but the first in order, and their names.

    Null is no level: its rows have 0 everywhere. More than ``most`` levels are refused, since the driver solves the system.
    """
    levels = sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(most + 1).collect())
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} levels")
    names = [f"{column}={v}" for v in levels[1:]]
    marks = {n: F.coalesce((F.col(column).cast("string") == v).cast("double"), F.lit(0.0)) for n, v in zip(names, levels[1:], strict=True)}
    return (df.withColumns(marks) if marks else df), names


def identified(fit: list[dict]) -> list[dict]:
    """The rows of ols() with a flag; errors and intervals are null unless the design has full rank, two clusters and residuals."""
    out = []
    for r in fit:
        full = r["rank"] == len(fit)
        held = full and r["clusters"] >= 2 and r["n"] > len(fit)
        out.append({**r, "identified": full, **({} if held else dict.fromkeys(("se", "low", "high")))})
    return out
