"""

The queries of the plain names draw few replicates, so that SQL can follow; ``<name>_full`` is the
same query over as many as its intervals and p values need. The first replicates are those of the
small query, by hash keys; the others come from generators that are seeded by names and have the same
law: what files of few patches can count is listed over all their orders, and files, draws and swaps
that can give the same are drawn together. Too slow for DuckDB, these have no SQL; tests hold them to it
at small counts, and the generators to the keys in law.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.operators import resample
from spanalign.plans import bindings, inference  # noqa: F401  (fills MAKES)
from spanalign.plans.registry import MAKES, QUERIES, SPARK, Dialect, frame, run_sql

REPS, BOOT = 10_000, 2_000


class Full(Dialect):
    """Spark's dialect with the bindings of few replicates replaced."""

    def __init__(self, **names):
        self.names = names

    def t(self, name):
        return super().t(self.names.get(name, name))


def _swapped(spark, sf):
    """rep, diff: the first replicates as SQL has them, the others by how many files of each difference have their sign swapped."""
    first = min(REPS, KEYED_BOOT)
    keyed = run_sql(spark, sf, bindings._swaps(SPARK, first)).select("rep", "diff")
    if first == REPS:
        return keyed
    classes = run_sql(spark, sf, "SELECT '' AS language, array(-size, 1L, size, 1L) AS histogram, count(*) AS n, CAST(NULL AS ARRAY<BIGINT>) AS sums FROM (SELECT abs(tp - fn) AS size FROM {per_file}) q GROUP BY size")
    return keyed.unionByName(resample.class_sums(classes, REPS, 5, first, "diff").where(F.col("rep") >= first).select("rep", "diff"))


#: Replicates by hash keys, as many as the queries draw that SQL follows; the others are drawn by generators.
KEYED, KEYED_BOOT = inference.REPS, inference.BOOT

bindings.FRAMES |= {
    "null_sums_full": lambda spark, sf: resample.replicate_sums(frame(spark, sf, "file_arrays"), REPS, 20260927, "hits", KEYED),
    "null_means_full": lambda spark, sf: resample.replicate_sums(frame(spark, sf, "file_arrays"), REPS, 20260927, "file", KEYED),
    "swaps_full": _swapped,
}
for _name, _rows, _seed, _by, _values, _once in inference.DRAWS:
    bindings.summed_draws(f"{_name}_full", f"SELECT * FROM {_rows(Full(null_counts='null_means_full'))} r", _seed, _by, _values, lambda: BOOT, lambda: KEYED_BOOT, _once)


def _register(name: str, counts=dict, **names) -> None:
    QUERIES[f"{name}_full"] = lambda spark, sf: run_sql(spark, sf, MAKES[name](Full(**names), **counts()))


for _name in ("i7_permutation_summary", "i8_permutation_z", "i9_two_tails", "e39_verdicts"):
    _register(_name, null_counts="null_sums_full")
_register("i10_file_bootstrap", null_draws="null_draws_full")
_register("i13_baseline_difference", base_draws="base_draws_full")
_register("i15_median_difference", size_draws="size_draws_full", size_draws_other="size_draws_other_full")
_register("i16_paired_randomisation", swaps="swaps_full")
_register("i18_clustered_bootstrap", lambda: {"reps": BOOT})


def prefix_null_full(spark, sf):
    return resample.replicate_sums(frame(spark, sf, "file_arrays"), REPS, 11, "prefix", KEYED)


QUERIES["i4_prefix_null_full"] = prefix_null_full
