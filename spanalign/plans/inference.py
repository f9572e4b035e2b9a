"""Queries: permutation nulls, bootstraps, randomisation tests, selection, regions, regression, perturbation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.operators import perturb, regress, resample
from spanalign.plans.bindings import summed_draws
from spanalign.plans.registry import SPARK, frame, query, shared

REPS, BOOT = 10, 20


@query("i3_fixed_eof_null", lambda d: f"SELECT file_id, rep, CAST(sum(off * pos) AS BIGINT) AS checksum, count(*) FILTER (WHERE reason = 'entropy' AND off < n_bytes) AS n FROM {d.t('null_ends')} GROUP BY file_id, rep")
def fixed_eof_null(spark, sf):
    ends = resample.permuted_ends(frame(spark, sf, "tiles"), REPS, 20260927)
    return ends.groupBy("file_id", "rep").agg(F.sum(F.col("off") * F.col("pos")).alias("checksum"), F.count_if((F.col("reason") == "entropy") & (F.col("off") < F.col("n_bytes"))).alias("n"))


@shared("f5_cumulative_endpoints")
def _(d):
    return f"SELECT file_id, CAST(sum(end_byte) AS BIGINT) AS total, max(end_byte) AS n_bytes FROM {d.t('tiles')} GROUP BY file_id"


@shared("g10_uniform_subset")
def _(d):
    """Two of each file's patches, by random keys."""
    return f"SELECT file_id, pos FROM (SELECT file_id, pos, row_number() OVER (PARTITION BY file_id ORDER BY {d.key(chr(39) + '3' + chr(39), 'file_id', 'pos')}, pos) AS r FROM {d.t('tiles')}) q WHERE r <= 2"


@shared("i4_prefix_null")
def _(d):
    """The first patch stays, the later ones are permuted."""
    h = d.key("'11'", "t.file_id", "r.rep", "t.pos")
    return f"""SELECT rep, language, CAST(sum(off) AS BIGINT) AS total FROM (SELECT rep, language, sum(len) OVER (PARTITION BY file_id, rep ORDER BY CASE WHEN pos = 1 THEN 0 ELSE 1 END, h, pos ROWS UNBOUNDED PRECEDING) AS off
      FROM (SELECT t.*, r.rep, {h} AS h FROM {d.t('tiles')} t CROSS JOIN (SELECT {d.series(0, 4)} AS rep) r) a) b GROUP BY rep, language"""


@shared("i5_null_counts")
def _(d):
    return f"SELECT language, rep, CAST(sum(tp) AS BIGINT) AS tp, count(*) AS n_files FROM {d.t('null_counts')} GROUP BY language, rep"


@shared("i6_null_any_match")
def _(d):
    return f"""SELECT rep, language, count(*) AS n FROM (SELECT DISTINCT n.file_id, n.language, n.rep, n.off FROM {d.t('null_ends')} n JOIN {d.t('starts')} s ON n.file_id = s.file_id AND abs(n.off - s.off) <= 1
      WHERE n.reason = 'entropy' AND n.off < n.n_bytes) q GROUP BY rep, language"""


def _pooled(d):
    """f1 of each language and replicate, and the observed one."""
    return f"""SELECT o.language, o.f1, {d.ratio('2 * n.tp', 'o.den')} AS h0, n.rep FROM
      (SELECT language, CAST(sum(2 * tp + fp + fn) AS BIGINT) AS den, {d.ratio('2 * sum(tp)', 'sum(2 * tp + fp + fn)')} AS f1 FROM {d.t('per_file')} GROUP BY language) o
      JOIN (SELECT language, rep, CAST(sum(tp) AS BIGINT) AS tp FROM {d.t('null_counts')} GROUP BY language, rep) n ON n.language = o.language"""


@shared("i7_permutation_summary")
def _(d):
    return f"""SELECT language, round(max(f1), 9) AS f1, round(avg(h0), 9) AS h0_mean, round(stddev_samp(h0), 9) AS h0_sd, round({d.pct('h0', 0.025)}, 9) AS h0_low, round({d.pct('h0', 0.975)}, 9) AS h0_high,
      round(CAST(1 + sum(CASE WHEN h0 >= f1 THEN 1 ELSE 0 END) AS DOUBLE) / (count(*) + 1), 9) AS p, round(max(f1) - avg(h0), 9) AS margin, round(CASE WHEN avg(h0) > 0 THEN max(f1) / avg(h0) END, 9) AS ratio FROM ({_pooled(d)}) q GROUP BY language"""


@shared("i8_permutation_z")
def _(d):
    return f"SELECT language, round((max(f1) - avg(h0)) / stddev_samp(h0), 6) AS z, count(*) AS n_valid FROM ({_pooled(d)}) q GROUP BY language"


@shared("i9_two_tails")
def _(d):
    return f"SELECT language, round(CAST(1 + sum(CASE WHEN h0 >= f1 THEN 1 ELSE 0 END) AS DOUBLE) / (count(*) + 1), 9) AS p_above, round(CAST(1 + sum(CASE WHEN h0 <= f1 THEN 1 ELSE 0 END) AS DOUBLE) / (count(*) + 1), 9) AS p_below FROM ({_pooled(d)}) q GROUP BY language"


def _weighted(d, name, table, cols, extra=""):
    """Sums of a file's counts under each resample; Spark makes them without a row for each file and resample."""
    if d.spark:
        return f"SELECT rep, {', '.join(cols)} FROM {d.t(name)}"
    sums = ", ".join(f"CAST(sum(b.weight * q.{c}) AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT b.rep, {sums} FROM {d.t('boot')} b JOIN {table} q ON q.file_id = b.file_id{extra} GROUP BY b.rep"


def _with_null(d):
    return f"(SELECT p.file_id, p.tp, p.fp, p.fn, c.m FROM {d.t('per_file')} p JOIN (SELECT file_id, avg(CAST(tp AS DOUBLE)) AS m FROM {d.t('null_counts')} GROUP BY file_id) c ON p.file_id = c.file_id)"


def _with_base(d):
    base = f"(SELECT file_id, CAST(sum(CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bt, count(*) AS bn FROM {d.t('tiles')} GROUP BY file_id)"
    return f"(SELECT p.file_id, p.tp, p.fp, p.fn, b.bt, b.bn FROM {d.t('per_file')} p JOIN {base} b ON p.file_id = b.file_id)"


#: name, rows by file over a dialect, seed, groups, sums, whether a file that is drawn counts once.
DRAWS = (
    ("null_draws", _with_null, 7, [], ["tp", "fp", "fn", "m"], False),
    ("base_draws", _with_base, 7, [], ["tp", "fp", "fn", "bt", "bn"], False),
    *((f"count_draws{other}", lambda d: d.t("per_file"), seed, ["language"], ["tp", "fp", "fn"], False) for other, seed in (("", 7), ("_other", 8))),
    *((f"size_draws{other}", lambda d: f"(SELECT file_id, language, n_bytes, 1 AS one FROM {d.t('files')} f)", seed, ["language", "n_bytes"], ["one"], True) for other, seed in (("", 7), ("_other", 8))),
)
for _name, _rows, _seed, _by, _values, _once in DRAWS:
    summed_draws(_name, f"SELECT * FROM {_rows(SPARK)} r", _seed, _by, _values, once=_once)


@shared("i10_file_bootstrap")
def _(d):
    joined = _with_null(d)
    f1, h0 = d.ratio("2 * tp", "(2 * tp + fp + fn)"), d.ratio("2 * m", "(2 * tp + fp + fn)")
    return f"""SELECT round({d.pct('f1', 0.025)}, 9) AS f1_low, round({d.pct('f1', 0.975)}, 9) AS f1_high, round({d.pct('f1 - h0', 0.025)}, 9) AS margin_low, round({d.pct('f1 - h0', 0.975)}, 9) AS margin_high, count(*) AS n
      FROM (SELECT rep, {f1} AS f1, {h0} AS h0 FROM ({_weighted(d, 'null_draws', joined, ('tp', 'fp', 'fn', 'm'))}) a) b"""


@query("i11_bootstrap_weights", lambda d: f"SELECT rep, count(*) AS n_units, CAST(sum(weight) AS BIGINT) AS total, CAST(sum(weight * file_id) AS BIGINT) AS checksum FROM {d.t('boot')} GROUP BY rep")
def bootstrap_weights(spark, sf):
    drawn = resample.drawn(frame(spark, sf, "files"), BOOT, 7, "file_id")
    return drawn.groupBy("rep").agg(F.count("*").alias("n_units"), F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("file_id")).alias("checksum"))


@shared("i13_baseline_difference")
def _(d):
    joined = _with_base(d)
    a, b = d.ratio("2 * tp", "(2 * tp + fp + fn)"), d.ratio("bt", "bn")
    return f"SELECT round({d.pct('x', 0.025)}, 9) AS low, round({d.pct('x', 0.5)}, 9) AS mid, round({d.pct('x', 0.975)}, 9) AS high FROM (SELECT {a} - {b} AS x FROM ({_weighted(d, 'base_draws', joined, ('tp', 'fp', 'fn', 'bt', 'bn'))}) q) r"


@shared("i15_median_difference")
def _(d):
    """Medians of two groups, each under resamples of its own; a file that is drawn counts once."""
    def median(boot, language):
        if d.spark:
            return f"(SELECT rep, CAST(percentile(n_bytes, 0.5, CAST(one AS BIGINT)) AS DOUBLE) AS m FROM {d.t(boot.replace('boot', 'size_draws'))} b WHERE language = '{language}' GROUP BY rep)"
        return f"(SELECT b.rep, CAST({d.pct('f.n_bytes', 0.5)} AS DOUBLE) AS m FROM {d.t(boot)} b JOIN {d.t('files')} f ON b.file_id = f.file_id WHERE f.language = '{language}' GROUP BY b.rep)"

    return f"SELECT x.rep, round(x.m - y.m, 6) AS diff FROM {median('boot', 'F')} x JOIN {median('boot_other', 'O')} y ON x.rep = y.rep"


@shared("i16_paired_randomisation")
def _(d):
    return f"""SELECT max(observed) AS observed, count(*) AS n, round(CAST(1 + sum(CASE WHEN diff >= observed THEN 1 ELSE 0 END) AS DOUBLE) / (count(*) + 1), 9) AS p FROM
      {d.t('swaps')} a
      CROSS JOIN (SELECT CAST(sum(tp - fn) AS BIGINT) AS observed FROM {d.t('per_file')}) o"""


@shared("i17_mann_whitney")
def _(d):
    """U from average ranks; normal approximation with tie and continuity correction."""
    x = f"SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS a, round(o_totalprice / 1000) AS v FROM {d.t('orders')} WHERE o_orderstatus IN ('F', 'O')"
    return f"""SELECT u, round((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS z FROM
      (SELECT CAST(sum(a * r) AS DOUBLE) - sum(a) * (sum(a) + 1) / 2.0 AS u, CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(1 - a) AS DOUBLE) AS n2, CAST(sum(CAST(c * c - 1 AS DOUBLE)) AS DOUBLE) AS ties FROM
        (SELECT a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, CAST(count(*) OVER (PARTITION BY v) AS DOUBLE) AS c FROM ({x}) x) q) s"""


@shared("i18_clustered_bootstrap")
def _(d, reps=20):
    h = d.hash32(d.key("'9'", "rep", "j"))
    clusters = f"(SELECT c_nationkey AS cl, CAST(sum(p.tp) AS BIGINT) AS tp, CAST(sum(p.fp + p.fn) AS BIGINT) AS miss FROM {d.t('per_file')} p JOIN {d.t('orders')} o ON o.o_orderkey = p.file_id JOIN {d.t('customer')} c ON c.c_custkey = o.o_custkey GROUP BY c_nationkey)"
    return f"""SELECT rep, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(miss) AS BIGINT) AS miss FROM (SELECT rep, {h} % n AS number FROM (SELECT rep, n, {d.series(0, 'n - 1')} AS j FROM (SELECT count(*) AS n FROM {clusters} c) x CROSS JOIN (SELECT {d.series(0, reps - 1)} AS rep) r) y) w
      JOIN (SELECT tp, miss, row_number() OVER (ORDER BY cl) - 1 AS number FROM {clusters} c) k ON k.number = w.number GROUP BY rep"""


@shared("i19_unpaired_difference")
def _(d):
    f1 = d.ratio("2 * tp", "(2 * tp + fp + fn)")
    def one(boot, language):
        if d.spark:
            return f"(SELECT rep, {f1} AS f1 FROM (SELECT rep, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM {d.t(boot.replace('boot', 'count_draws'))} b WHERE language = '{language}') q)"
        sums = ", ".join(f"CAST(sum(b.weight * p.{c}) AS BIGINT) AS {c}" for c in ("tp", "fp", "fn"))
        return f"(SELECT rep, {f1} AS f1 FROM (SELECT b.rep, {sums} FROM {d.t(boot)} b JOIN {d.t('per_file')} p ON p.file_id = b.file_id WHERE p.language = '{language}' GROUP BY b.rep) q)"

    return f"SELECT x.rep, round(x.f1 - y.f1, 9) AS diff FROM {one('boot', 'F')} x JOIN {one('boot_other', 'O')} y ON x.rep = y.rep"


@shared("i20_paired_margin")
def _(d):
    return f"SELECT rep, round({d.ratio('2 * (tp - m)', '(2 * tp + fp + fn)')}, 9) AS margin FROM ({_weighted(d, 'null_draws', _with_null(d), ('tp', 'fp', 'fn', 'm'))}) q"


@shared("i23_position_rates")
def _(d):
    return f"""SELECT o.language, x.shift, count(*) AS n, CAST(sum(CASE WHEN p.off IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM {d.t('starts')} o CROSS JOIN (SELECT {d.series(0, 6)} AS shift) x
      LEFT JOIN {d.t('predictions')} p ON p.file_id = o.file_id AND p.off = o.off + x.shift GROUP BY o.language, x.shift"""


@shared("f31_offsets_from_start")
def _(d):
    return f"SELECT step, count(*) AS n FROM (SELECT doc_id, start_byte, end_byte, {d.series(1, 6)} AS step FROM {d.t('words')}) q WHERE start_byte + step < end_byte GROUP BY step"


@shared("f32_distance_buckets")
def _(d):
    return f"""SELECT CASE WHEN gap <= 1 THEN 'adjacent' WHEN gap <= 8 THEN 'near' WHEN gap <= 32 THEN 'middle' ELSE 'far' END AS bucket, count(*) AS n, max(gap) AS largest FROM
      (SELECT start_byte - lag(end_byte) OVER (PARTITION BY doc_id ORDER BY start_byte) AS gap FROM {d.t('words')}) q WHERE gap IS NOT NULL GROUP BY CASE WHEN gap <= 1 THEN 'adjacent' WHEN gap <= 8 THEN 'near' WHEN gap <= 32 THEN 'middle' ELSE 'far' END"""


def _curve(d):
    """Median per-file recall of any-match by language and k."""
    return f"""SELECT f.language, x.k, CAST({d.pct('coalesce(h.n, 0)', 0.5)} AS DOUBLE) AS med, round(avg(CAST(coalesce(h.n, 0) AS DOUBLE)), 9) AS mean FROM {d.t('files')} f CROSS JOIN (SELECT {d.series(0, 4)} AS k) x
      LEFT JOIN (SELECT file_id, language, k, count(*) AS n FROM (SELECT DISTINCT s.file_id, s.language, s.off, x.k FROM {d.t('starts')} s JOIN {d.t('predictions')} p ON p.file_id = s.file_id CROSS JOIN (SELECT {d.series(0, 4)} AS k) x
        WHERE abs(p.off - s.off) <= x.k) q GROUP BY file_id, language, k) h ON h.file_id = f.file_id AND h.k = x.k GROUP BY f.language, x.k"""


@shared("i24_calibration_curve")
def _(d):
    return f"SELECT language, k, med, mean FROM ({_curve(d)}) c"


@shared("g7_argmax_smallest_k")
def _(d):
    return f"SELECT language, min(k) AS k FROM (SELECT language, k, mean - k * 0.3 AS m, max(mean - k * 0.3) OVER (PARTITION BY language) AS best FROM ({_curve(d)}) c) q WHERE m >= best - 0.000000000001 GROUP BY language"


@shared("i26_tau_selection")
def _(d):
    one = f"SELECT language, tau, avg(CASE WHEN len > tau THEN 1.0 ELSE 0.0 END) AS a, CAST({d.pct('CASE WHEN len > tau THEN len ELSE 0 END', 0.5)} AS DOUBLE) AS b FROM {d.t('tiles')} CROSS JOIN (SELECT {d.series(1, 5)} * 9 AS tau) t GROUP BY language, tau" if not d.spark else f"SELECT language, tau, avg(CASE WHEN len > tau THEN 1.0 ELSE 0.0 END) AS a, CAST({d.pct('CASE WHEN len > tau THEN len ELSE 0 END', 0.5)} AS DOUBLE) AS b FROM {d.t('tiles')} CROSS JOIN (SELECT t * 9 AS tau FROM (SELECT {d.series(1, 5)} AS t) u) t GROUP BY language, tau"
    return f"""SELECT x.language, x.tau AS tau_a, y.tau AS tau_b, x.tau = y.tau AS agree FROM (SELECT language, min(tau) AS tau FROM (SELECT *, max(a) OVER (PARTITION BY language) AS best FROM ({one}) q) r WHERE a >= best - 0.000000000001 GROUP BY language) x
      JOIN (SELECT language, min(tau) AS tau FROM (SELECT *, max(b) OVER (PARTITION BY language) AS best FROM ({one}) q) r WHERE b >= best - 0.000000000001 GROUP BY language) y ON x.language = y.language"""


@shared("g9_strongest_baseline")
def _(d):
    return f"""SELECT language, baseline, n FROM (SELECT language, baseline, n, row_number() OVER (PARTITION BY language ORDER BY n DESC, rnk) AS r FROM (SELECT language, reason AS baseline, count(*) AS n, min(CASE reason WHEN 'entropy' THEN 0 WHEN 'max_length' THEN 1 ELSE 2 END) AS rnk
      FROM {d.t('tiles')} GROUP BY language, reason) a) b WHERE r = 1"""


@shared("g11_worst_condition")
def _(d):
    return f"SELECT language, min(CASE WHEN m = low THEN flag END) AS worst, round(min(m), 6) AS delta FROM (SELECT language, flag, m, min(m) OVER (PARTITION BY language) AS low FROM (SELECT language, flag, avg(CAST(len AS DOUBLE)) AS m FROM {d.t('tiles')} GROUP BY language, flag) a) b GROUP BY language"


@shared("e39_verdicts")
def _(d):
    return f"""SELECT language, CASE WHEN lo > 0 THEN 'above' WHEN hi < 0 THEN 'below' WHEN lo IS NULL THEN 'unresolved' ELSE 'indistinguishable' END AS verdict FROM
      (SELECT language, {d.pct('f1 - h0', 0.025)} AS lo, {d.pct('f1 - h0', 0.975)} AS hi FROM ({_pooled(d)}) q GROUP BY language) r"""


@shared("e40_arms_passing")
def _(d):
    return f"SELECT flag AS arm, CAST(sum(CASE WHEN m > 25.4 THEN 1 ELSE 0 END) AS BIGINT) AS n_passing, sum(CASE WHEN m > 25.4 THEN 1 ELSE 0 END) >= 2 AS accepted FROM (SELECT flag, language, avg(CAST(len AS DOUBLE)) AS m FROM {d.t('tiles')} GROUP BY flag, language) q GROUP BY flag"


@shared("i30_alignment_table")
def _(d):
    p = d.ratio("tp", "(tp + fp)")
    r = d.ratio("tp", "(tp + fn)")
    return f"SELECT language, round(max(CASE WHEN metric = 'p' THEN v END), 9) AS p, round(max(CASE WHEN metric = 'r' THEN v END), 9) AS r FROM (SELECT language, 'p' AS metric, {p} AS v FROM (SELECT language, sum(tp) AS tp, sum(fp) AS fp FROM {d.t('per_file')} GROUP BY language) a UNION ALL SELECT language, 'r', {r} FROM (SELECT language, sum(tp) AS tp, sum(fn) AS fn FROM {d.t('per_file')} GROUP BY language) b) q GROUP BY language"


# -- regions and regression ------------------------------------------------------------------------


def _regions(d):
    """Patches as regions with covariates: how much of a region other spans cover, and densities."""
    return f"""SELECT t.file_id, t.language, t.pos AS region_id, t.len AS region_length, CASE WHEN t.flag = 'R' THEN 1.0 ELSE 0.0 END AS unsafe, CASE WHEN t.status = 'F' THEN 1.0 ELSE 0.0 END AS control,
      CAST(count(n.node_id) AS DOUBLE) / t.len AS density FROM {d.t('tiles')} t LEFT JOIN {d.t('nodes')} n ON n.file_id = t.file_id AND n.start_byte >= t.start_byte AND n.start_byte < t.end_byte
      GROUP BY t.file_id, t.language, t.pos, t.len, t.flag, t.status"""


@shared("i32_region_table")
def _(d):
    return f"SELECT file_id, region_id, region_length, CAST(unsafe AS DOUBLE) AS unsafe, round(density, 9) AS density, round(density * {'0.6931471805599453D' if d.spark else '0.6931471805599453::DOUBLE'}, 9) AS density_nats FROM ({_regions(d)}) q"


@query("i33_ols_moments", lambda d: f"SELECT count(*) AS n, round(regr_slope(density, CAST(unsafe AS DOUBLE)), 9) AS slope, round(regr_intercept(density, CAST(unsafe AS DOUBLE)), 9) AS intercept FROM ({_regions(d)})")
def ols_moments(spark, sf):
    """One regressor and a constant: from the same moments as the general fit."""
    rows = _region_rows(spark, sf)
    fit = {r["term"]: r for r in regress.ols(rows, "density", ["one", "unsafe"], "file_id")}
    return spark.createDataFrame([(fit["one"]["n"], round(fit["unsafe"]["estimate"], 9), round(fit["one"]["estimate"], 9))], "n bigint, slope double, intercept double")


def _region_rows(spark, sf):
    from spanalign.plans.registry import SPARK, run_sql

    rows = run_sql(spark, sf, _regions(SPARK))
    return rows.select("file_id", F.col("density"), F.col("unsafe").cast("double").alias("unsafe"), F.col("control").cast("double").alias("control"), F.col("region_length").cast("double").alias("size"), F.lit(1.0).alias("one"))


@query("i34_demeaned_ols", lambda d: f"""WITH r AS ({_regions(d)}), m AS (SELECT file_id, density - avg(density) OVER w AS y, CAST(unsafe AS DOUBLE) - avg(CAST(unsafe AS DOUBLE)) OVER w AS x FROM r WINDOW w AS (PARTITION BY file_id)),
  b AS (SELECT sum(x * y) / sum(x * x) AS beta, 1 / sum(x * x) AS bread, count(*) AS n FROM m), g AS (SELECT sum(s * s) AS meat, count(*) AS g FROM (SELECT file_id, sum(x * (y - beta * x)) AS s FROM m, b GROUP BY file_id))
  SELECT 'unsafe' AS term, round(beta, 8) AS estimate, round(sqrt(bread * meat * bread * g / (g - 1.0) * (n - 1.0) / (n - 1.0 - g)), 8) AS se, n, g AS clusters FROM b, g""")
def demeaned_ols(spark, sf):
    rows = regress.demeaned(_region_rows(spark, sf), ["density", "unsafe"], "file_id")
    fit = regress.ols(rows, "density", ["unsafe"], "file_id", absorbed=True)[0]
    return spark.createDataFrame([(fit["term"], round(fit["estimate"], 8), round(fit["se"], 8), fit["n"], fit["clusters"])], "term string, estimate double, se double, n bigint, clusters bigint")


@query("i33_ols_dummies")
def ols_dummies(spark, sf):
    """The same with region length and a dummy for each language but the first."""
    from spanalign.plans.registry import SPARK, run_sql

    rows = run_sql(spark, sf, _regions(SPARK)).select("file_id", "language", "density", F.col("unsafe").cast("double").alias("unsafe"), F.col("region_length").cast("double").alias("size"), F.lit(1.0).alias("one"))
    rows, levels = regress.with_levels(rows, "language")
    fit = regress.identified(regress.ols(rows, "density", ["one", "unsafe", "size", *levels], "file_id"))
    out = [(r["term"], round(r["estimate"], 8), None if r["se"] is None else round(r["se"], 8), r["n"], r["rank"], r["identified"]) for r in fit]
    return spark.createDataFrame(out, "term string, estimate double, se double, n bigint, rank bigint, identified boolean")


@query("i35_nested_models")
def nested_models(spark, sf):
    """The same coefficient under growing sets of controls, inside files."""
    rows = regress.demeaned(_region_rows(spark, sf), ["density", "unsafe", "control", "size"], "file_id").persist()
    out = []
    for name, columns in (("A", ["unsafe"]), ("B", ["unsafe", "control"]), ("C", ["unsafe", "control", "size"])):
        fit = regress.ols(rows, "density", columns, "file_id", absorbed=True)[0]
        out.append((name, round(fit["estimate"], 8), round(fit["se"], 8), fit["n"], fit["rank"]))
    rows.unpersist()
    return spark.createDataFrame(out, "model string, estimate double, se double, n bigint, rank bigint")


@shared("i36_region_sampling")
def _(d):
    """Files with both kinds of region; the first 1,500 by hash; of each at most five regions of each kind by hash rank."""
    h = d.key("'20260927'", "file_id", "pos")
    return f"""SELECT file_id, flag, pos FROM (SELECT file_id, flag, pos, row_number() OVER (PARTITION BY file_id, flag ORDER BY {h}) AS r FROM (SELECT file_id, pos, CASE WHEN flag = 'R' THEN 'unsafe' ELSE 'clean' END AS flag FROM {d.t('tiles')}) t
      WHERE file_id IN (SELECT file_id FROM {d.t('tiles')} GROUP BY file_id HAVING sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN flag <> 'R' THEN 1 ELSE 0 END) > 0
        ORDER BY {d.key("'20260927'", 'file_id')}, file_id LIMIT 1500)) q WHERE r <= 5"""


# -- perturbation ----------------------------------------------------------------------------------


@query("i37_indentation_noise", lambda d: """SELECT doc_id, count(*) FILTER (WHERE u < 0.2 * 4294967296) AS n_edits, sha256(string_agg(CASE WHEN u < 0.2 * 4294967296 THEN '  ' || line ELSE line END, chr(10) ORDER BY i)) AS sha256 FROM
  (SELECT doc_id, line, i, CAST('0x' || substr(sha256('20260927' || chr(0) || doc_id || chr(0) || i), 1, 8) AS BIGINT) AS u FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)) GROUP BY doc_id""")
def indentation_noise(spark, sf):
    out = perturb.indent_noise(frame(spark, sf, "documents"), rate=0.2, seed=20260927)
    return out.select("doc_id", "n_edits", F.sha2("noised", 256).alias("sha256"))


@query("i37_letter_swap", lambda d: """SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE new <> old) AS n_changed FROM (SELECT doc_id, old, CASE WHEN length(old) < 3 THEN old ELSE substr(old, 1, j) || substr(old, j + 2, 1) || substr(old, j + 1, 1) || substr(old, j + 3) END AS new FROM
  (SELECT doc_id, old, CAST('0x' || substr(sha256('1' || chr(0) || doc_id || chr(0) || i), 1, 8) AS BIGINT) % greatest(1, length(old) - 1) AS j FROM (SELECT doc_id, unnest(w) AS old, unnest(range(len(w))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))) GROUP BY doc_id""")
def letter_swap(spark, sf):
    return perturb.swap_letters(frame(spark, sf, "documents"), seed=1)


@query("hs19_apply_edits", lambda d: "SELECT doc_id, sha256(regexp_replace(text, '([.]) ', '\\1\\1 ', 'g')) AS sha256, octet_length(encode(text)) + len(regexp_extract_all(text, '[.] ')) AS n_bytes FROM documents")
def apply_edits(spark, sf):
    """A second full stop after each that a space follows, as an edit script of inserts."""
    docs = frame(spark, sf, "documents")
    out = perturb.apply_edits(docs, perturb.insert_after(docs, "[.](?= )", "."))
    return out.select("doc_id", F.sha2("edited", 256).alias("sha256"), F.octet_length("edited").cast("long").alias("n_bytes"))
