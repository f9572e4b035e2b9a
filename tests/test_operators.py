"""Hand-made inputs with known results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanalign.functions import bytesops, distributions, tables
from spanalign.operators import baselines, guards, harness, lexer, matching, offsets, perturb, regress, resample, sampling, segment, validate
from spanalign.sources import readers, writers


def starts(spark, scores, tau):
    df = spark.createDataFrame([(scores,)], "s array<float>")
    return [(r["start"], r["trigger"]) for r in df.select(segment.patch_starts("s", tau).alias("p")).first()["p"]]


def test_threshold_is_strict(spark):
    tau = 1.5
    assert [s for s, _ in starts(spark, [9.0, 0.1, 2.0, 0.5, 1.4, tau, 3.0], tau)] == [0, 2, 6]
    assert [s for s, _ in starts(spark, [0.0, tau, float(np.nextafter(np.float32(tau), np.float32(9)))], tau)] == [0, 2]
    assert starts(spark, [0.0], tau) == [(0, "init")]


def test_patches_tile_the_document(spark):
    docs = spark.createDataFrame([(1, "ab cd, é\nxyz"), (2, ""), (3, None)], "doc_id long, text string")
    rows = segment.patches(docs, 1.3, 2).orderBy("start_byte").collect()
    assert {r["doc_id"] for r in rows} == {1}
    at = 0
    for r in rows:
        assert r["start_byte"] == at and 0 < r["patch_length"] <= 2
        at += r["patch_length"]
    assert at == len("ab cd, é\nxyz".encode())


@pytest.mark.parametrize("text, want", [(b"The cat, sat: on\tMAT_2 mats.", [0, 4, 9, 14, 17, 23]), ("café noir".encode(), [0, 6]), (b"123 !!!", [0])])
def test_word_starts(spark, text, want):
    docs = spark.createDataFrame([(1, text.decode())], "doc_id long, text string")
    assert [r["start_byte"] for r in bytesops.pieces(docs, "[A-Za-z0-9_]+").orderBy("idx").collect()] == want


def test_indent_changes(spark):
    docs = spark.createDataFrame([(1, "a\n  b\n\n \t\n  c\nd\n")], "doc_id long, text string")
    assert [r["byte_offset"] for r in baselines.indent_changes(docs).orderBy("byte_offset").collect()] == [4, 14]
    assert [r["byte_offset"] for r in baselines.newlines(docs).orderBy("byte_offset").collect()] == [2, 6, 7, 10, 14]


def greedy(p, t, k):
    n, last = 0, -1
    for x in p:
        hit = [y for y in t if y > last and abs(x - y) <= k]
        if hit:
            last, n = min(hit), n + 1
    return n


def test_one_to_one_is_greedy(spark):
    rng = random.Random(1)
    cases = [([10], [9, 11], 1, 1), ([9, 11], [10], 1, 1), ([10, 20], [10, 20], 0, 2)]
    for _ in range(50):
        p, t = (sorted(rng.sample(range(40), rng.randint(0, 9))) for _ in "pt")
        cases.append((p, t, 2, greedy(p, t, 2)))
    for k in {c[2] for c in cases}:
        some = [c for c in cases if c[2] == k]
        df = spark.createDataFrame([(c[0], c[1], c[3]) for c in some], "p array<long>, t array<long>, want long")
        assert df.where(matching.one_to_one("p", "t", k) != F.col("want")).count() == 0


def test_counts_and_metrics(spark):
    p = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "file_id long, off long")
    t = spark.createDataFrame([(1, 5), (3, 2)], "file_id long, off long")
    rows = {r["file_id"]: r for r in matching.counts_by_file(p, t, 0).select("*", *matching.zero_safe()).collect()}
    assert (rows[1]["tp"], rows[1]["fp"], rows[1]["fn"]) == (1, 1, 0)
    assert rows[2]["f1"] == 0 and rows[3]["fn"] == 1
    near, found = matching.within(p, t, 4)
    assert sorted((r["file_id"], r["off"]) for r in near.collect()) == [(1, 5), (1, 9)]
    assert [(r["file_id"], r["off"]) for r in found.collect()] == [(1, 5)]


def test_null_keeps_lengths_and_last(spark):
    rows = [(1, i + 1, ln, "eof" if i == 3 else "entropy", 10, 4) for i, ln in enumerate((1, 2, 3, 4))]
    tiles = spark.createDataFrame(rows, "file_id long, pos long, len long, reason string, n_bytes long, n_patches long")
    ends = resample.permuted_ends(tiles, 20, 5)
    for r in ends.groupBy("rep").agg(F.sort_array(F.collect_list("off")).alias("o")).collect():
        assert r["o"][-1] == 10 and sorted(np.diff([0, *r["o"]]).tolist()[:-1]) == [1, 2, 3]
    assert ends.where("reason = 'eof' AND off <> 10").count() == 0


def test_draws_sum_to_units(spark):
    units = spark.createDataFrame([(i,) for i in range(30)], "u long")
    assert {r["s"] for r in resample.drawn(units, 5, 1, "u").groupBy("rep").agg(F.sum("weight").alias("s")).collect()} == {30}
    assert resample.drawn(units.limit(0), 5, 1, "u").count() == 0


def test_ols_recovers_a_line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    rows = [(int(i % 10), 1.0, float(a), float(2 + 3 * a)) for i, a in enumerate(x)]
    fit = {r["term"]: r for r in regress.ols(spark.createDataFrame(rows, "f long, one double, x double, y double"), "y", ["one", "x"], "f")}
    assert abs(fit["x"]["estimate"] - 3) < 1e-9 and abs(fit["one"]["estimate"] - 2) < 1e-9


def test_lpt(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3)], "g string, n long")
    assert {r["g"]: r["shard"] for r in sampling.lpt(rows, "g", "n", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(ValueError):
        sampling.lpt(rows, "g", "n", 2, most=2)


def test_edits(spark):
    docs = spark.createDataFrame([(1, "a. b. c"), (2, "")], "doc_id long, text string")
    out = perturb.apply_edits(docs, perturb.insert_after(docs, "[.](?= )", "!"))
    assert {r["doc_id"]: r["edited"] for r in out.collect()} == {1: "a.! b.! c", 2: ""}


def test_tiling_problems(spark):
    rows = [(1, 1, 0, 3, 9, "entropy", 3), (1, 2, 4, 4, 9, "eof", 3), (1, 3, 4, 8, 9, "eof", 3)]
    tiles = spark.createDataFrame(rows, "file_id long, pos long, start_byte long, end_byte long, n_bytes long, reason string, n_patches long")
    assert sorted(r["rule"] for r in validate.tiling_problems(tiles, 100).collect()) == ["empty", "eof", "gap", "length"]


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    path = f"file://{tmp_path}/t"
    assert [writers.if_changed(df, path), writers.if_changed(df.orderBy(F.desc("id")), path), writers.if_changed(df.limit(1), path)] == ["written", "skipped", "rewrote"]
    assert readers.parquet(spark, path, ["s"]).count() == 1
    with pytest.raises(ValueError):
        readers.parquet(spark, path, ["nothing"])
    parted = f"file://{tmp_path}/p"
    writers.replace_partitions(df.withColumn("d", F.lit("x")), parted, "d")
    writers.replace_partitions(df.withColumn("d", F.lit("y")), parted, "d")
    writers.replace_partitions(df.limit(1).withColumn("d", F.lit("y")), parted, "d")
    assert {r["d"]: r["count"] for r in spark.read.parquet(parted).groupBy("d").count().collect()} == {"x": 2, "y": 1}
    assert writers.register(df, f"file://{tmp_path}/r", "id", ["s"]).count() == 0
    assert writers.register(df.withColumn("s", F.lit("z")), f"file://{tmp_path}/r", "id", ["s"]).count() == 2
    writers.json_lines(df, f"file://{tmp_path}/j")
    assert readers.json_lines(spark, f"file://{tmp_path}/j", "id long, s string").count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bin").write_bytes(b"ab")
    files = readers.binary(spark, f"file://{tmp_path}/b")
    sha = files.first()["sha256"]
    manifest = spark.createDataFrame([("x", 2, sha), ("y", 1, sha), ("x", 3, sha)], "file_id string, n_bytes long, sha256 string")
    good, bad = readers.verified(files, manifest)
    assert good.count() == 1 and sorted(r["problem"] for r in bad.collect()) == ["length", "missing"]
    assert writers.fingerprint(df) == writers.fingerprint(df.repartition(3))


def test_full_replicates_at_small_counts(spark, sf_dir, monkeypatch):
    """The queries of many replicates are the ones that SQL follows, at their counts."""
    from spanalign.plans import QUERIES, replicates

    assert (replicates.REPS, replicates.BOOT) == (10_000, 2_000)

    def rows(name, where="true"):
        got = QUERIES[name](spark, sf_dir).where(where)
        return sorted(str([f"{r[c]:.9g}" if isinstance(r[c], float) else r[c] for c in sorted(got.columns)]) for r in got.collect())

    monkeypatch.setattr(replicates, "BOOT", 20)
    for reps, names in ((10, "i7_permutation_summary i8_permutation_z i9_two_tails e39_verdicts i10_file_bootstrap i13_baseline_difference i18_clustered_bootstrap"), (20, "i16_paired_randomisation")):
        monkeypatch.setattr(replicates, "REPS", reps)
        for name in names.split():
            assert rows(f"{name}_full") == rows(name), name
    assert rows("i4_prefix_null_full", "rep < 5") == rows("i4_prefix_null")
    assert rows("i15_median_difference_full") == rows("i15_median_difference")


def test_offset_maps(spark):
    text = "aé中🙂\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "xy")], "doc_id long, text string")
    got = {r["doc_id"]: r["bytes"] for r in offsets.char_to_byte(docs).collect()}
    assert got == {1: [0, 1, 3, 6, 10, 11], 2: [0], 3: [0], 4: [0, 1, 2]}
    back = {r["doc_id"]: r["chars"] for r in offsets.byte_to_char(docs).collect()}
    assert back == {1: [0, 1, -1, 2, -1, -1, 3, -1, -1, -1, 4, 5], 2: [0], 3: [0], 4: [0, 1, 2]}
    assert {r["doc_id"]: r["ids"] for r in offsets.token_ids(docs).collect()} == {k: [1, *(b + 4 for b in (t or "").encode())] for k, t in ((1, text), (2, ""), (3, None), (4, "xy"))}
    edges = docs.where("doc_id = 1").select("text", F.explode(F.sequence(F.lit(-1), F.lit(12))).alias("o")).select(offsets.is_char_boundary("text", "o").alias("e")).collect()
    assert [r["e"] for r in edges] == [o in (0, 1, 3, 6, 10, 11) for o in range(-1, 13)]
    asked = spark.createDataFrame([(1, 3), (1, 4), (1, 12), (9, 0)], "doc_id long, off long")
    rows = {(r["doc_id"], r["off"]): (r["converted"], r["problem"]) for r in offsets.converted(asked, offsets.byte_to_char(docs), "doc_id", "off", "chars").collect()}
    assert rows == {(1, 3): (2, None), (1, 4): (None, "inside_character"), (1, 12): (None, "outside"), (9, 0): (None, "outside")}


def test_token_functions(spark):
    row = spark.createDataFrame([([0.1, 2.0, 0.5, 3.0], [3, 2, 1, 4, 0, 0])], "s array<double>, p array<bigint>").withColumn("n", F.lit(9))
    assert row.select(offsets.byte_scores("s").alias("x")).first()["x"] == [0.1, 2.0, 0.5]
    assert row.select(offsets.start_ids("s", 1.0).alias("x")).first()["x"] == [0, 1, 2, 4]
    assert row.select(offsets.start_ids("s", 1.0, False).alias("x")).first()["x"] == [0, 1, 2]
    # tokens 0..2 are the start token and bytes 0 and 1; the next patch starts at byte 2
    assert row.select(offsets.patch_byte_starts("p", "n").alias("x")).first()["x"] == [2, 4, 5]


def test_lexer_labels():
    assert lexer.tokens('a->b <<= 0x1F; // c\n"x\\"y" \'c\' /* d\n */ .5f') == [("name", "a"), ("operator", "->"), ("name", "b"), ("operator", "<<="), ("number", "0x1F"), ("operator", ";"), ("string", '"x\\"y"'), ("string", "'c'"), ("number", ".5f")]
    cases = {
        "x = *p;": {"*"}, "x = a * b;": set(), "f(&x)": {"&"}, "a & b": set(), "return *p": {"*"}, "(a) * b": set(), "new int": {"new"}, "operator new": set(), "T() = delete;": set(), "delete p;": {"delete"},
        "memcpy(a, b, 3)": {"call"}, "x.free(1)": set(), "p->free(1)": set(), "reinterpret_cast<int>(x)": {"cast"}, "(char *) p": {"cast"}, "(unsigned char **)(p)": {"cast"}, "// *p": set(), "(a * b)": set(),
    }
    assert {t: lexer.labels(t) for t in cases} == cases


def test_distributions(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [0.2, 0.3, 0.5], 0.0, -0.0, float("nan"), 12.3456, 0.00123, None)], "z array<double>, p array<double>, a double, b double, c double, d double, e double, f double")
    got = row.select(distributions.log_softmax("z").alias("q"), "*").select(distributions.cross_entropy("p", "q").alias("h"), distributions.divergence("p", "q").alias("k"), distributions.same_bits("a", "b").alias("ab"), distributions.same_bits("c", "c").alias("cc"), distributions.shown_number("d").alias("d"), distributions.shown_number("e").alias("e"), distributions.shown_interval("d", "e", "f").alias("i")).first()
    q = np.array([1, 2, 3]) - np.log(np.exp([1, 2, 3]).sum())
    p = np.array([0.2, 0.3, 0.5])
    assert abs(got["h"] + (p * q).sum()) < 1e-12 and abs(got["k"] - (p * (np.log(p) - q)).sum()) < 1e-12
    assert not got["ab"] and got["cc"] and got["d"] == "12.3" and got["e"] == "0.00123" and got["i"] == "12.3 [0.00123, ??]"


def test_best_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        edges = np.unique(np.concatenate([[0, 60], rng.integers(1, 60, 8)]))
        s = rng.integers(0, 59, 20)
        e = s + 1 + rng.integers(0, 60 - s)
        want = [max((min(b, d) - max(a, c)) / (max(b, d) - min(a, c)) for c, d in zip(edges[:-1], edges[1:], strict=True) if min(b, d) > max(a, c)) for a, b in zip(s, e, strict=True)]
        assert np.allclose(harness.best_overlap(s, e, edges), want)


def test_summaries_and_scans(spark):
    texts = ["", None, "a b", "x" * 300 + " y\n z", "é é\n\t(é)", "\n\n a\n  b \n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in segment.summaries(docs, [1.3], 7).collect()}
    cut = {}
    for r in segment.patches(docs, 1.3, 7).collect():
        cut.setdefault(r["doc_id"], []).append((r["patch_index"], r["start_byte"], r["patch_length"], r["trigger"]))
    assert set(rows) == set(cut) == {2, 3, 4, 5}
    for k, parts in cut.items():
        parts.sort()
        lengths = [p[2] for p in parts]
        assert [p[1] for p in parts] == np.cumsum([0, *lengths[:-1]]).tolist() and sum(lengths) == len(texts[k].encode()) and max(lengths) <= 7
        assert abs(rows[k]["median_bpp"] - np.median(lengths)) < 1e-9 and abs(rows[k]["var_bpp"] - np.var(lengths)) < 1e-9 and rows[k]["n_length_cap"] == sum(p[3] == "length_cap" for p in parts)
    lines = sorted((r["doc_id"], r["i"], r["start_byte"], r["line"]) for r in baselines.lines(docs).collect())
    want = []
    for k, t in enumerate(texts):
        at = 0
        for i, line in enumerate([] if t is None else t.split("\n")):
            want.append((k, i, at, line))
            at += len(line.encode()) + 1
    assert lines == want


def test_boundary_rules_fire(spark):
    """A right table breaks nothing; each mutation breaks the rule that names it."""
    right = [(1, 0, 0, 4, "init", 9.0), (1, 1, 4, 4, "length_cap", None), (1, 2, 8, 2, "entropy", 2.0)]

    def rules(rows, longest=4, files=((1, 10), (2, 0))):
        table = spark.createDataFrame(list(rows), "doc_id long, patch_index int, start_byte long, patch_length int, trigger string, score float")
        known = spark.createDataFrame(list(files), "doc_id long, n_bytes long")
        return {r["rule"] for r in validate.boundary_table_problems(table, known, 1.5, longest).collect()}

    def changed(row, at, value):
        return [(*r[:at], value, *r[at + 1 :]) if k == row else r for k, r in enumerate(right)]

    assert rules(right) == set()
    assert rules([]) == {"no_rows"} and rules(right, None) == {"cap_unset"}
    assert rules(right, files=((1, 0),)) >= {"rows_of_empty_file", "outside", "sum", "step"}
    assert "unknown_file" in rules([(7, *r[1:]) for r in right])
    wanted = {"null": (1, 4, None), "trigger": (2, 4, "other"), "first": (0, 4, "entropy"), "init_again": (2, 4, "init"), "order": (2, 2, 4), "outside": (2, 2, 10), "index": (2, 1, 5), "not_positive": (2, 3, 0), "step": (2, 3, 1), "sum": (2, 3, 1), "not_finite": (2, 5, float("nan")), "not_above": (2, 5, 1.5), "cap_above": (1, 5, 2.0), "cap_early": (0, 3, 3), "long": (0, 3, 5)}
    for rule, change in wanted.items():
        assert rule in rules(changed(*change)), rule
    assert set(wanted) | {"no_rows", "cap_unset", "rows_of_empty_file", "unknown_file"} == set(validate.BOUNDARY_RULES)


def test_score_and_summary_rules(spark):
    series = [(1, [0.0, 1.0], 2), (2, None, 2), (3, [1.0], 2), (4, [float("nan"), float("inf")], 2), (5, [-1.0, None], 2), (6, [9.0, 0.0], 2)]
    rows = spark.createDataFrame(series, "doc_id long, s array<double>, n int")
    assert {(r["doc_id"], r["rule"]) for r in validate.score_problems(rows, "s", "n", 5.6).collect()} == {(2, "missing"), (3, "length"), (4, "not_finite"), (5, "negative"), (5, "not_finite"), (6, "above")}
    schema = "doc_id long, n_patches long, n_bytes long, mean_bpp double, var_bpp double, min_bpp int, max_bpp int, n_init long, n_entropy long, n_length_cap long"
    rows = spark.createDataFrame([(1, 2, 6, 3.0, 1.0, 2, 4, 1, 1, 0), (2, 2, 6, 3.5, 0.5, 2, 4, 1, 1, 0), (3, 2, 6, 3.0, 9.0, 2, 4, 1, 0, 0), (4, 0, 0, None, None, None, None, 0, 0, 0)], schema)
    assert {(r["doc_id"], r["rule"]) for r in validate.summary_problems(rows).collect()} == {(2, "mean"), (3, "variance"), (3, "triggers")}


def test_guards(spark):
    record = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "name string, digest string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("d", "4")], "name string, digest string")
    assert {tuple(r) for r in guards.frozen_problems(record, now).collect()} == {("b", "changed"), ("d", "unknown")}
    guards.require(guards.frozen_problems(record, record), "record")
    with pytest.raises(ValueError, match="record: "):
        guards.require(guards.frozen_problems(now, record), "record")


def test_indexed_and_latest(spark, tmp_path):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(50)] + [(7, "again")], "id long, s string")
    writers.indexed(df, f"file://{tmp_path}/x", "id", 8)
    assert readers.one_row(readers.rows_of(spark, f"file://{tmp_path}/x", "id", 3, 8), "3")["s"] == "v3"
    for k in (7, 99):
        with pytest.raises(ValueError):
            readers.one_row(readers.rows_of(spark, f"file://{tmp_path}/x", "id", k, 8), str(k))
    assert readers.inside("/r/", "a/b") == "/r/a/b"
    for name in ("../x", "/x", "file:x", "a/../../x"):
        with pytest.raises(ValueError):
            readers.inside("/r", name)
    path = f"file://{tmp_path}/u"
    writers.upsert(df.where("id < 2"), path)
    writers.upsert(df.where("id = 1").withColumn("s", F.lit("new")), path)
    writers.upsert(df.where("id = 0"), path, deleted=True)
    assert [tuple(r) for r in readers.latest(spark, path, "id").collect()] == [(1, "new")]
    writers.register_analysis(df.where("id < 2"), f"file://{tmp_path}/a", df, "1")
    writers.register_analysis(df.where("id < 1"), f"file://{tmp_path}/a", df, "2")
    assert {(r["id"], r["code"]) for r in readers.latest(spark, f"file://{tmp_path}/a", "id").collect()} == {(0, "2"), (1, "1")}


def test_dummies_and_typeset_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 7, 1.0, float(rng.normal()), "abc.d"[k % 5], float(k % 5)) for k in range(100)]
    frame, levels = regress.with_levels(spark.createDataFrame(rows, "f long, one double, x double, g string, z double"), "g")
    frame = frame.withColumn("y", F.col("x") * 2 + F.col("z"))
    fit = regress.identified(regress.ols(frame, "y", ["one", "x", *levels], "f"))
    design = np.array([[1.0, r[2], *(float(r[3] == v) for v in sorted("abc.d")[1:])] for r in rows])
    want = np.linalg.lstsq(design, np.array([2 * r[2] + r[4] for r in rows]), rcond=None)[0]
    assert np.allclose([r["estimate"] for r in fit], want) and all(r["identified"] and r["se"] is not None for r in fit)
    twice = regress.identified(regress.ols(frame.withColumn("same", F.col("x")), "y", ["one", "x", "same"], "f"))
    assert not any(r["identified"] for r in twice) and all(r["se"] is None for r in twice)
    with pytest.raises(ValueError):
        regress.with_levels(frame, "g", 4)
    one = spark.createDataFrame([("a_1 & 50%\\", None, "x|y\nz")], "a string, b int, c string")
    got = one.select(tables.latex_row("a", "b").alias("l"), tables.markdown_row("c", "b").alias("m"), tables.latex_macro("a", "b").alias("d")).first()
    assert tuple(got) == ("a\\_1 \\& 50\\%\\textbackslash{} & ?? \\\\", "| x\\|y z | ?? |", "\\newcommand{\\abfa}{??}")
