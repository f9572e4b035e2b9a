"""Replicates of many: generators have the law of the keys, and nothing is made for each unit and replicate."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanalign.operators import resample

FILES = "file_id long, language string, n_bytes long, pos array<bigint>, len array<bigint>, entropy array<boolean>, starts array<bigint>"


def files(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        length = rng.integers(1, 9, n).tolist()
        total = sum(length)
        rows.append((k, "ab"[k % 2], total, list(range(1, n + 1)), length, [bool(x) for x in rng.random(n - 1) < 0.8] + [False], sorted(rng.choice(np.arange(1, total), max(1, total // 3), False).tolist()) if total > 1 else []))
    return rows, spark.createDataFrame(rows, FILES)


def law(row, prefix):
    """Mean and variance of what a file counts over all orders of its patches."""
    _, _, total, _, length, entropy, starts = row
    n, got = len(length), []
    for some in itertools.permutations(range(1, n) if prefix else range(n - 1)):
        order = [0, *some] if prefix else [*some, n - 1]
        ends = np.cumsum([length[i] for i in order])
        got.append(ends.sum() if prefix else sum(entropy[i] and e < total and e in starts for i, e in zip(order, ends.tolist(), strict=True)))
    return np.mean(got), np.var(got)


@pytest.mark.parametrize("what", ["hits", "prefix"])
def test_generators_have_the_law_of_orders(spark, what):
    rows, df = files(spark, [1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 7, 8, 8])
    name, reps = ("total", 6_000) if what == "prefix" else ("tp", 6_000)
    got = resample.replicate_sums(df, reps, 9, what, 2)
    assert got.where("rep < 2").orderBy("language", "rep").collect() == resample.replicate_sums(df, 2, 9, what).orderBy("language", "rep").collect()
    for language in "ab":
        x = np.array([r[name] for r in got.where(F.col("language") == language).where("rep >= 2").collect()])
        laws = [law(r, what == "prefix") for r in rows if r[1] == language]
        mean, var = sum(a for a, _ in laws), sum(b for _, b in laws)
        assert len(x) == reps - 2
        assert abs(x.mean() - mean) < 4 * np.sqrt(var / len(x)) and abs(x.var() / var - 1) < 0.1
    again = resample.replicate_sums(df.repartition(5), reps, 9, what, 2)
    assert got.exceptAll(again).count() == 0


def test_file_means_and_long_files(spark):
    rows, df = files(spark, [1, 3, 5, 7, 8, 16])
    mean = {r["file_id"]: r["tp"] for r in resample.replicate_sums(df, 4_000, 9, "file", 10).collect()}
    for r in rows[:-1]:
        m, v = law(r, False)
        assert abs(mean[r[0]] - m) <= 4 * np.sqrt(v / 4_000)
    keyed = {r["file_id"]: r["tp"] for r in resample.replicate_sums(df, 1_000, 9, "file").collect()}
    assert abs(keyed[5] - mean[5]) < 0.3
    counts = resample.hit_counts(np.array([rows[4][4]]), np.array([rows[4][5]]), np.zeros(1, np.int64), np.isin(np.arange(rows[4][2] + 1), rows[4][6]))
    assert counts.sum() == 5040 and abs((counts[0] @ np.arange(8)) / 5040 - law(rows[4], False)[0]) < 1e-9


def test_equal_keys_fall_back_on_the_whole_key():
    order = resample.keyed_orders([b"s\0a\0"], [[b"\0%d" % p for p in (1, 2, 1, 3)]], 2)
    for own in order[0].tolist():
        assert own.index(0) + 1 == own.index(2)


def test_resampled_sums(spark):
    n, reps, keyed = 300, 4_000, 6
    rng = np.random.default_rng(1)
    table = [(k, "xyz"[k % 3], int(rng.integers(0, 4)), float(rng.random()) if k % 3 else None) for k in range(n - 20)]
    rows = spark.createDataFrame(table, "u long, g string, a long, b double")
    units = spark.range(n).withColumnRenamed("id", "u")
    got = resample.resampled(rows, units, reps, 5, "u", ["g"], ["a", "b"], keyed)
    want = resample.drawn(units, keyed, 5, "u").join(rows, "u").groupBy("rep", "g").agg(F.sum(F.col("weight") * F.col("a")).cast("double").alias("a"), F.sum(F.col("weight") * F.col("b")).alias("b"))
    flat = lambda df: sorted((r["rep"], r["g"], r["a"], None if r["b"] is None else round(r["b"], 9)) for r in df.collect())
    assert flat(got.where(F.col("rep") < keyed)) == flat(want)
    for k, g in enumerate("xyz"):
        x = np.array([r["a"] for r in got.where((F.col("g") == g) & (F.col("rep") >= keyed)).collect()])
        own = np.array([r[2] for r in table[k::3]])
        var = (own**2).sum() - own.sum() ** 2 / n
        assert len(x) == reps - keyed and abs(x.mean() - own.sum()) < 4 * np.sqrt(var / len(x)) and abs(x.var() / var - 1) < 0.1
    once = resample.resampled(rows, units, reps, 5, "u", ["g"], ["a"], keyed, once=True)
    assert {(r["rep"], r["g"]): r["a"] for r in once.where(F.col("rep") < keyed).collect()} == {(r["rep"], r["g"]): r["a"] for r in resample.drawn(units, keyed, 5, "u").join(rows, "u").groupBy("rep", "g").agg(F.sum("a").alias("a")).collect()}
    x = np.array([r["a"] for r in once.where((F.col("g") == "x") & (F.col("rep") >= keyed)).collect()])
    assert abs(x.mean() / sum(r[2] for r in table[::3]) - (1 - (1 - 1 / n) ** n)) < 0.01
    assert resample.resampled(rows, units.limit(0), 5, 5, "u", ["g"], ["a"], 2).count() == 0


@pytest.mark.parametrize("name", ["i7_permutation_summary", "i13_baseline_difference", "i16_paired_randomisation"])
def test_many_replicates_shuffle_no_units(spark, sf_dir, name):
    """The whole plan reads no row for each replicate and file: neither draws nor coins are exploded."""
    from spanalign.plans import QUERIES

    plan = QUERIES[f"{name}_full"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 9999" not in plan and "Range (0, 3000000" not in plan


def test_shuffled_rows_are_uniform_orders():
    """All orders come alike, by sorted words and by the generator's own permutations."""
    from spanalign.operators import harness

    for lengths in ([1, 2, 3, 4], [300, 2, 3, 4]):
        rows = harness._shuffled(resample.generator("x"), np.array(lengths), 24_000)
        _, n = np.unique(rows, axis=0, return_counts=True)
        assert len(n) == 24 and ((n - 1_000) ** 2 / 1_000).sum() < 60  # chi-squared of 23 degrees of freedom
    got = list(harness._Orders(5, 7, True).ends(3, np.array([5, 1, 2, 9])))
    assert sum(len(x) for x in got) == 7 and (np.concatenate(got)[:, -1] == 8).all()


def test_keys_are_shared_and_exact():
    """Keys held for a longer and a shorter segmentation give the orders that keys made anew give."""
    from spanalign.operators import harness

    held, lengths = harness._Orders(5, 4, True), np.arange(1, 40)
    for n in (20, 39, 7):
        want = [x for x in harness._Orders(5, 4, True).ends("k", lengths[:n])]
        assert all((a == b).all() for a, b in zip(held.ends("k", lengths[:n]), want, strict=True))
        order = resample.keyed_orders([b"5\0k\0"], [[b"\0%d" % p for p in range(1, n)]], 4)[0]
        assert (np.concatenate(want) == np.cumsum(lengths[: n - 1][order], 1)).all()


@pytest.mark.parametrize("name", ["i20_two_run_margin", "i21_noise_robustness", "dj22_noised_pairs", "i22_overlap_layouts"])
def test_texts_are_counted_once(spark, sf_dir, name):
    """The query's own plan reads what was counted of the texts and makes nothing of it again."""
    from spanalign.plans import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "hash" not in plan


def test_openers(spark, sf_dir):
    from spanalign.operators import harness
    from spanalign.plans import bindings
    from spanalign.plans.registry import SPARK, frame, run_sql

    docs = frame(spark, sf_dir, "documents")
    got = harness.openers(docs, bindings.TAU, bindings.SENTENCE)
    want = run_sql(spark, sf_dir, f"""SELECT t.doc_id, count_if(c) AS n_capital, count_if(c AND p.doc_id IS NOT NULL) AS hit_capital, count_if(NOT c) AS n_other, count_if(NOT c AND p.doc_id IS NOT NULL) AS hit_other
      FROM (SELECT doc_id, start_byte, {SPARK.matches('piece', '^[A-Z]')} AS c FROM {{sentences}} WHERE start_byte > 0) t LEFT JOIN {{patches}} p ON p.doc_id = t.doc_id AND p.start_byte = t.start_byte GROUP BY t.doc_id""")
    assert got.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_length_histogram_joins_nothing(spark, sf_dir):
    from spanalign.plans import QUERIES

    plan = QUERIES["e20_length_histogram"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
