"""Guards: a run that rests on a frozen record is refused when what it rests on has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frozen_problems(record: DataFrame, now: DataFrame, key: str = "name", value: str = "digest") -> DataFrame:
    """key, problem: missing (now lacks it), unknown (the record lacks it), changed. Null values equal nulls only.

    Either side without rows gives the other's keys; a key that repeats is compared each time.
    """
    a = record.select(F.col(key), F.struct(F.col(value)).alias("a"))
    b = now.select(F.col(key).alias("b_key"), F.struct(F.col(value)).alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unknown").when(~F.col("a")[value].eqNullSafe(F.col("b")[value]), "changed")
    found = a.join(b, F.col(key).eqNullSafe(F.col("b_key")), "full").select(F.coalesce(key, "b_key").alias(key), problem.alias("problem"))
    return found.where("problem IS NOT NULL")


def require(problems: DataFrame, what: str, shown: int = 5) -> None:
    """Raises with the first few problems, if there are any."""
    rows = problems.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(", ".join(str(v) for v in r) for r in rows))
