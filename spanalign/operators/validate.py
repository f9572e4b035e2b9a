"""Validators: each gives rows for what is wrong and none for what is right; none of them raises."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanalign.functions.scans import numbers, scan


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def tiling_problems(tiles: DataFrame, longest: int) -> DataFrame:
    """file_id, rule of patches that don't tile their file. All rules look at one scan of the table."""
    before = F.coalesce(F.lag("end_byte").over(Window.partitionBy("file_id").orderBy("pos")), F.lit(0))
    rules = {
        "gap": before != F.col("start_byte"),
        "empty": F.col("end_byte") <= F.col("start_byte"),
        "eof": (F.col("reason") == "eof") != (F.col("pos") == F.col("n_patches")),
        "length": (F.col("pos") == F.col("n_patches")) & (F.col("end_byte") != F.col("n_bytes")),
        "long": F.col("end_byte") - F.col("start_byte") > longest,
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))
    return tiles.select("file_id", found.alias("rules")).select("file_id", F.explode("rules").alias("rule"))


def boundary_problems(patches: DataFrame, tau: float, longest: int, key: str = "doc_id") -> DataFrame:
    """key, rule of boundary rows that break the threshold, the first byte's rule or the length."""
    rules = {
        "score_not_above": (F.col("trigger") == "entropy") & (F.col("score").cast("double") <= tau),
        "init_not_zero": (F.col("trigger") == "init") != (F.col("start_byte") == 0),
        "long": F.col("patch_length") > longest,
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))
    return patches.select(key, found.alias("rules")).select(key, F.explode("rules").alias("rule"))


#: Rules of a boundary table as SQL over one scan of it: rows by patch_index, each with what stands before and after.
#: has: a row of the table; known: its file is; place: its number; last: no row follows; total: lengths up to it.
BOUNDARY_RULES = {
    "null": "has AND (patch_index IS NULL OR start_byte IS NULL OR patch_length IS NULL OR trigger IS NULL)",
    "unknown_file": "has AND NOT known",
    "no_rows": "NOT has AND n_bytes > 0",
    "rows_of_empty_file": "has AND n_bytes = 0",
    "trigger": "has AND trigger NOT IN ('init', 'entropy', 'length_cap')",
    "first": "has AND place = 1 AND NOT (start_byte = 0 AND trigger = 'init')",
    "init_again": "has AND place > 1 AND trigger = 'init'",
    "order": "has AND start_byte <= before",
    "outside": "has AND (start_byte < 0 OR start_byte >= n_bytes)",
    "index": "has AND patch_index <> place - 1",
    "not_positive": "has AND patch_length < 1",
    "step": "has AND patch_length <> coalesce(after, n_bytes) - start_byte",
    "sum": "has AND last AND total <> n_bytes",
    "not_finite": "has AND trigger <> 'length_cap' AND (score IS NULL OR NOT (CAST(score AS DOUBLE) BETWEEN -1e300 AND 1e300))",
    "not_above": "has AND trigger = 'entropy' AND CAST(score AS DOUBLE) <= {tau}",
    "cap_above": "has AND trigger = 'length_cap' AND CAST(score AS DOUBLE) > {tau}",
    "cap_unset": "has AND trigger = 'length_cap' AND {longest} IS NULL",
    "cap_early": "has AND trigger = 'length_cap' AND before_length <> {longest}",
    "long": "has AND patch_length > {longest}",
}


def boundary_rules(tau: float, longest: int | None) -> dict[str, str]:
    cap = "CAST(NULL AS INT)" if longest is None else str(longest)
    return {k: r.format(tau=f"CAST({tau!r} AS DOUBLE)", longest=cap) for k, r in BOUNDARY_RULES.items()}


def boundary_table_problems(rows: DataFrame, files: DataFrame, tau: float, longest: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, rule for every row of a boundary table, or file without rows, that breaks a rule.

    ``files`` has key and n_bytes, one row a file. A null key is no file's; an empty table breaks no_rows only.
    One shuffle by key; a file's rows are read in order, so that no file is held as a whole.
    """
    w = Window.partitionBy(key).orderBy(F.col("patch_index").asc_nulls_last(), F.col("start_byte").asc_nulls_first())
    have = rows.select(key, "patch_index", "start_byte", "patch_length", "trigger", "score", F.lit(True).alias("has"))
    x = have.join(files.select(key, "n_bytes", F.lit(True).alias("known")), key, "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has", "known")})
    x = x.withColumns({
        "place": F.row_number().over(w),
        "before": F.lag("start_byte").over(w),
        "after": F.lead("start_byte").over(w),
        "before_length": F.lag("patch_length").over(w),
        "last": F.lead("has").over(w).isNull(),
        "total": F.sum("patch_length").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    found = F.array_compact(F.array(*(F.when(F.expr(r), F.lit(k)) for k, r in boundary_rules(tau, longest).items())))
    return x.select(key, F.explode(found).alias("rule"))


def score_problems(rows: DataFrame, scores: str, n: str, greatest: float, key: str = "doc_id") -> DataFrame:
    """key, rule of score series that are missing, of another length than ``n``, not finite, negative or above ``greatest``."""
    x = F.col(scores)

    def finite(v):
        return ~F.isnan(v) & (F.abs(v) < float("inf"))

    rules = {
        "missing": x.isNull(),
        "length": F.size(x) != F.col(n),
        "not_finite": F.exists(x, lambda v: v.isNull() | ~finite(v)),
        "negative": F.exists(x, lambda v: v < 0),
        "above": F.exists(x, lambda v: finite(v) & (v > greatest)),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
    return rows.select(key, F.explode(found).alias("rule"))


#: Rules of summaries of bytes per patch, one row a file and run, as SQL.
SUMMARY_RULES = {
    "null": "n_patches IS NULL OR n_bytes IS NULL",
    "negative": "n_patches < 0 OR n_bytes < 0 OR var_bpp < 0",
    "more_patches_than_bytes": "n_patches > n_bytes",
    "mean": "n_patches > 0 AND (mean_bpp IS NULL OR abs(mean_bpp * n_patches - n_bytes) > 0.000001 * n_bytes)",
    "order": "min_bpp > mean_bpp OR mean_bpp > max_bpp",
    "variance": "var_bpp > (max_bpp - mean_bpp) * (mean_bpp - min_bpp) + 0.000001",
    "triggers": "n_init + n_entropy + n_length_cap <> n_patches",
    "starts": "n_init <> CASE WHEN n_patches > 0 THEN 1 ELSE 0 END",
}


def summary_problems(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, rule of summaries whose numbers contradict each other."""
    found = F.array_compact(F.array(*(F.when(F.expr(r), F.lit(k)) for k, r in SUMMARY_RULES.items())))
    return rows.select(key, F.explode(found).alias("rule"))


def span_problems(docs: DataFrame, every: int, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, problem of spans of ``width`` bytes at every ``every``-th byte: outside, cuts a character, ok."""
    def find(data, ends):
        begins = np.concatenate([[0], ends[:-1]])
        n = -(-(ends - begins) // every)
        row = np.repeat(np.arange(len(ends)), n)
        start = begins[row] + every * numbers(row)
        end = start + width
        inside = np.concatenate([(data & 0xC0) == 0x80, np.zeros(width + 1, bool)])
        kind = np.where(end > ends[row], 0, np.where(inside[start] | (inside[end] & (end < ends[row])), 1, 2))
        return row, [pa.DictionaryArray.from_arrays(pa.array(kind, pa.int8()), pa.array(["outside", "cuts_character", "ok"])).cast(pa.string())]

    return scan(docs, key, text, find, "problem string")


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_missing, n_extra, n_rows: rows of a that b lacks, of b that a lacks, and of a, as bags."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("a__"), F.lit(0).alias("b__")).unionAll(b.select(*columns, F.lit(0), F.lit(1)))
    counts = both.groupBy(*columns).agg(F.sum("a__").alias("a"), F.sum("b__").alias("b"))
    zero = F.lit(0).cast("long")
    return counts.agg(F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), zero)), zero).alias("n_missing"), F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), zero)), zero).alias("n_extra"), F.coalesce(F.sum("a"), zero).alias("n_rows"))
