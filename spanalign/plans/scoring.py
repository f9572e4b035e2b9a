"""Queries: matching, joins over spans, pooled metrics, strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.operators import matching
from spanalign.plans.registry import frame, query, shared


def _metrics(d):
    return f"round({d.ratio('tp', '(tp + fp)')}, 9) AS precision, round({d.ratio('tp', '(tp + fn)')}, 9) AS recall, round({d.ratio('2 * tp', '(2 * tp + fp + fn)')}, 9) AS f1"


# -- joins -----------------------------------------------------------------------------------------


@query("dj8_exact_match", lambda d: f"SELECT count(*) AS n FROM {d.t('predictions')} a JOIN {d.t('starts')} b ON a.file_id = b.file_id AND a.off = b.off")
def exact_match(spark, sf):
    return matching.exact_matches(frame(spark, sf, "predictions"), frame(spark, sf, "starts")).agg(F.count("*").alias("n"))


def _greedy(k, targets="starts"):
    def make(d):
        return f"""WITH RECURSIVE p AS (SELECT file_id, off, row_number() OVER (PARTITION BY file_id ORDER BY off) AS i, count(*) OVER (PARTITION BY file_id) AS n FROM {d.t('predictions')}),
          t AS (SELECT file_id, list(off ORDER BY off) AS t FROM {d.t(targets)} GROUP BY file_id),
          pl AS (SELECT file_id, list(off ORDER BY off) AS p FROM {d.t('predictions')} GROUP BY file_id),
          b AS (SELECT file_id, coalesce(p, []) AS p, coalesce(t, []) AS t FROM pl FULL JOIN t USING (file_id)),
          g AS (SELECT file_id, p, t, 1 AS i, -1::BIGINT AS last, 0::BIGINT AS tp FROM b
            UNION ALL SELECT file_id, p, t, i + 1, coalesce(m, last), tp + (m IS NOT NULL)::BIGINT FROM
              (SELECT *, list_min([x for x in t if x > last and x >= p[i] - {k} and x <= p[i] + {k}]) AS m FROM g WHERE i <= len(p)))
          SELECT file_id, tp, len(p) - tp AS fp, len(t) - tp AS fn FROM g WHERE i = len(p) + 1"""

    return make


@query("dj9_one_to_one_match", _greedy(2))
def one_to_one_match(spark, sf):
    """Greedy matching within two bytes, as a fold over each file's sorted arrays."""
    out = matching.counts_by_file(frame(spark, sf, "predictions"), frame(spark, sf, "starts"), 2)
    return out.select("file_id", "tp", F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"))


def _counts(targets):
    def run(spark, sf):
        out = matching.counts_by_file(frame(spark, sf, "predictions"), frame(spark, sf, targets), 0)
        return out.select("file_id", "tp", F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"))

    return run


query("e1_counts_starts", _greedy(0))(_counts("starts"))
query("e1_counts_ends", _greedy(0, "ends"))(_counts("ends"))


def _any(side):
    a, b = ("predictions", "starts") if side == "precision" else ("starts", "predictions")
    return lambda d: f"SELECT a.file_id, count(*) AS n FROM {d.t(a)} a WHERE EXISTS (SELECT 1 FROM {d.t(b)} b WHERE a.file_id = b.file_id AND abs(a.off - b.off) <= 3) GROUP BY a.file_id"


@query("dj10_any_match_precision", _any("precision"))
def any_match_precision(spark, sf):
    return matching.within(frame(spark, sf, "predictions"), frame(spark, sf, "starts"), 3)[0].groupBy("file_id").agg(F.count("*").alias("n"))


@query("dj11_any_match_recall", _any("recall"))
def any_match_recall(spark, sf):
    return matching.within(frame(spark, sf, "predictions"), frame(spark, sf, "starts"), 3)[1].groupBy("file_id").agg(F.count("*").alias("n"))


@shared("dj1_manifest_lookup")
def _(d):
    return f"SELECT p.doc_id, p.n, m.language, m.n_bytes FROM (SELECT doc_id, count(*) AS n FROM {d.t('lines')} GROUP BY doc_id) p JOIN {d.t('manifest')} m ON p.doc_id = m.doc_id"


@shared("dj2_optional_lookup")
def _(d):
    return f"SELECT m.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM {d.t('manifest')} m LEFT JOIN {d.t('labels')} l ON m.doc_id = l.doc_id"


@shared("dj3_semi_join")
def _(d):
    return f"SELECT doc_id, language FROM {d.t('manifest')} m WHERE EXISTS (SELECT 1 FROM {d.t('labels')} l WHERE l.doc_id = m.doc_id AND l.quality = 1)"


@shared("dj4_anti_join")
def _(d):
    return f"SELECT p.file_id, p.off FROM {d.t('predictions')} p WHERE NOT EXISTS (SELECT 1 FROM {d.t('starts')} s WHERE s.file_id = p.file_id AND s.off = p.off)"


@shared("dj6_completeness")
def _(d):
    return f"""SELECT o.o_orderkey AS file_id, coalesce(t.total, 0) AS covered FROM {d.t('orders')} o LEFT JOIN (SELECT file_id, min(n_bytes) AS n, CAST(sum(len) AS BIGINT) AS total FROM {d.t('tiles')} GROUP BY file_id) t
      ON o.o_orderkey = t.file_id WHERE t.total IS NULL OR t.total <> t.n"""


@shared("dj7_status_fill")
def _(d):
    return f"""SELECT coalesce(s.user_id, c.c_custkey) AS file_id, CASE WHEN s.status IS NULL THEN 'pending' WHEN s.status = 'view' THEN 'interrupted' ELSE s.status END AS status FROM
      (SELECT user_id, {d.max_by('event_type', 'i')} AS status FROM {d.t('series')} GROUP BY user_id) s FULL OUTER JOIN (SELECT c_custkey FROM {d.t('customer')}) c ON s.user_id = c.c_custkey"""


_REGIONS = "SELECT file_id, pos AS region_id, start_byte, end_byte, language, flag, status, line FROM {t} WHERE len >= 10"
_MASKS = "SELECT file_id, s AS start_byte, least(n_bytes, s + 12) AS end_byte FROM (SELECT file_id, n_bytes, (partkey + pos) % n_bytes AS s FROM {t} WHERE status = 'F') q"


def _regions(d):
    return "(" + _REGIONS.format(t=d.t("tiles")) + ")"


def _masks(d):
    return "(" + _MASKS.format(t=d.t("tiles")) + ")"


@shared("dj12_overlap_flag")
def _(d):
    return f"""SELECT r.file_id, r.region_id, max(CASE WHEN greatest(r.start_byte, m.start_byte) < least(r.end_byte, m.end_byte) THEN 1 ELSE 0 END) AS unsafe
      FROM {_regions(d)} r LEFT JOIN {_masks(d)} m ON r.file_id = m.file_id GROUP BY r.file_id, r.region_id"""


def _clipped(d):
    return f"""(SELECT r.file_id, r.region_id, r.start_byte AS rs, r.end_byte AS re, greatest(r.start_byte, m.start_byte) AS s, least(r.end_byte, m.end_byte) AS e
      FROM {_regions(d)} r JOIN {_masks(d)} m ON r.file_id = m.file_id WHERE greatest(r.start_byte, m.start_byte) < least(r.end_byte, m.end_byte))"""


@shared("dj13_interval_union")
def _(d):
    return f"""SELECT file_id, region_id, CAST(sum(CASE WHEN before IS NULL OR s >= before THEN e - s WHEN e > before THEN e - before ELSE 0 END) AS BIGINT) AS covered FROM
      (SELECT *, max(e) OVER (PARTITION BY file_id, region_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_clipped(d)} c) q GROUP BY file_id, region_id"""


@shared("dj14_patch_mass")
def _(d):
    return f"""SELECT r.file_id, r.region_id, round(sum(CAST(least(r.end_byte, t.end_byte) - greatest(r.start_byte, t.start_byte) AS DOUBLE) / t.len), 9) AS mass
      FROM (SELECT file_id, pos AS region_id, start_byte / 2 * 1.0 AS x, start_byte + 1 AS start_byte, least(n_bytes, end_byte + 7) AS end_byte FROM {d.t('tiles')}) r
      JOIN {d.t('tiles')} t ON r.file_id = t.file_id AND greatest(r.start_byte, t.start_byte) < least(r.end_byte, t.end_byte) GROUP BY r.file_id, r.region_id"""


@shared("dj15_boundary_in_region")
def _(d):
    return f"""SELECT r.file_id, r.region_id, count(t.pos) AS n FROM {_regions(d)} r LEFT JOIN {d.t('tiles')} t ON r.file_id = t.file_id AND t.end_byte >= r.start_byte AND t.end_byte < r.end_byte
      AND t.end_byte > 0 AND t.end_byte < t.n_bytes AND t.reason IN ('entropy', 'max_length') GROUP BY r.file_id, r.region_id"""


@shared("dj16_containment_depth")
def _(d):
    return f"""SELECT a.file_id, a.node_id, count(b.node_id) AS constituents FROM {d.t('nodes')} a LEFT JOIN {d.t('nodes')} b ON a.file_id = b.file_id AND b.start_byte <= a.start_byte AND b.end_byte >= a.end_byte
      AND b.depth < a.depth AND b.node_type <> 'module' GROUP BY a.file_id, a.node_id"""


@shared("dj17_asof_patch")
def _(d):
    last = "last(p, true)" if d.spark else "last_value(p IGNORE NULLS)"
    return f"""SELECT file_id, node_id, patch FROM (SELECT file_id, node_id, {last} OVER (PARTITION BY file_id ORDER BY x, k, node_id ROWS UNBOUNDED PRECEDING) AS patch FROM
      (SELECT file_id, start_byte AS x, 0 AS k, pos AS p, CAST(NULL AS {'STRING' if d.spark else 'VARCHAR'}) AS node_id FROM {d.t('tiles')}
       UNION ALL SELECT file_id, start_byte, 1, NULL, node_id FROM {d.t('nodes')}) q) r WHERE node_id IS NOT NULL"""


def _celled(d, table, columns, size=64):
    """Rows of a table of spans, once for each cell of so many bytes that they reach into."""
    return f"(SELECT {columns}, {d.series(d.int_div('start_byte', size), d.int_div('(end_byte - 1)', size))} AS cell FROM {table} c WHERE end_byte > start_byte)"


@shared("dj18_best_iou")
def _(d):
    a, b = _celled(d, d.t("nodes"), "file_id, node_id, start_byte, end_byte"), _celled(d, d.t("tiles"), "file_id, start_byte, end_byte")
    return f"""SELECT n.file_id, n.node_id, round(max(CAST(least(n.end_byte, t.end_byte) - greatest(n.start_byte, t.start_byte) AS DOUBLE) / (greatest(n.end_byte, t.end_byte) - least(n.start_byte, t.start_byte))), 9) AS iou
      FROM {a} n JOIN {b} t ON n.file_id = t.file_id AND n.cell = t.cell AND greatest(n.start_byte, t.start_byte) < least(n.end_byte, t.end_byte) GROUP BY n.file_id, n.node_id"""


@shared("e30_mean_iou")
def _(d):
    a, b = _celled(d, f"(SELECT DISTINCT file_id, language, start_byte, end_byte FROM {d.t('nodes')})", "file_id, language, start_byte, end_byte"), _celled(d, d.t("tiles"), "file_id, start_byte, end_byte")
    return f"""SELECT language, round(sum(iou) / count(*), 9) AS mean_iou, count(*) AS n_spans FROM (SELECT n.file_id, n.language, n.start_byte, n.end_byte,
        max(CAST(least(n.end_byte, t.end_byte) - greatest(n.start_byte, t.start_byte) AS DOUBLE) / (greatest(n.end_byte, t.end_byte) - least(n.start_byte, t.start_byte))) AS iou
      FROM {a} n JOIN {b} t ON n.file_id = t.file_id AND n.cell = t.cell AND greatest(n.start_byte, t.start_byte) < least(n.end_byte, t.end_byte) GROUP BY n.file_id, n.language, n.start_byte, n.end_byte) q GROUP BY language"""


@shared("g18_unique_spans")
def _(d):
    return f"SELECT DISTINCT file_id, start_byte, end_byte FROM {d.t('nodes')} WHERE end_byte > start_byte"


@shared("dj20_edit_offset_mapping")
def _(d):
    """Edits insert two bytes for every third patch's first four; an offset strictly inside has no image (-1)."""
    edits = f"(SELECT file_id, start_byte AS a, start_byte + least(4, len) AS b, 6 - least(4, len) AS delta FROM {d.t('tiles')} WHERE pos % 3 = 0)"
    return f"""SELECT n.file_id, n.node_id, CASE WHEN max(CASE WHEN e.a < n.start_byte AND n.start_byte < e.b THEN 1 ELSE 0 END) = 1 THEN -1
        ELSE n.start_byte + coalesce(CAST(sum(CASE WHEN e.b <= n.start_byte THEN e.delta ELSE 0 END) AS BIGINT), 0) END AS new_start
      FROM {d.t('nodes')} n LEFT JOIN {edits} e ON n.file_id = e.file_id GROUP BY n.file_id, n.node_id, n.start_byte"""


@shared("dj23_condition_fanout")
def _(d):
    return f"""SELECT m.doc_id, concat(c.condition, CASE WHEN c.rate IS NULL THEN '' ELSE concat('_r', c.rate) END) AS condition FROM {d.t('manifest')} m
      CROSS JOIN (SELECT 'clean' AS condition, CAST(NULL AS {'STRING' if d.spark else 'VARCHAR'}) AS rate UNION ALL SELECT 'indentation', '0.1' UNION ALL SELECT 'indentation', '0.2' UNION ALL SELECT 'keyword_typo', '0.1') c"""


@shared("dj24_grid_fanout")
def _(d):
    return f"SELECT k, kind, language, count(*) AS n FROM (SELECT {d.series(0, 4)} AS k, kind, language FROM (SELECT 'start' AS kind, language FROM {d.t('starts')} UNION ALL SELECT 'end', language FROM {d.t('ends')}) a) b GROUP BY k, kind, language"


@shared("dj25_taxonomy_lookup")
def _(d):
    first = "split_part(s.node_type, '+', 1)"
    return f"""SELECT coalesce(t.category, u.category, 'unmapped') AS category, count(*) AS n FROM (SELECT concat(node_type, CASE WHEN depth = 2 THEN '+x' ELSE '' END) AS node_type FROM {d.t('spans')}) s
      LEFT JOIN (SELECT 'line' AS k, 'layout' AS category UNION ALL SELECT 'word', 'token' UNION ALL SELECT 'capital', 'token') t ON t.k = s.node_type
      LEFT JOIN (SELECT 'sentence' AS k, 'clause' AS category) u ON u.k = {first} GROUP BY coalesce(t.category, u.category, 'unmapped')"""


@shared("dj26_patch_label_shift")
def _(d):
    """From labels of patch starts to labels of patch ends: the next row's, and eof for the last."""
    return f"""SELECT doc_id, start_byte, start_byte + patch_length AS end_byte, CASE coalesce(lead(trigger) OVER (PARTITION BY doc_id ORDER BY patch_index), 'eof') WHEN 'length_cap' THEN 'max_length'
      WHEN 'entropy' THEN 'entropy' ELSE 'eof' END AS termination_reason FROM {d.t('patches')}"""


@shared("dj27_label_audit")
def _(d):
    return f"""SELECT CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'left' ELSE 'right' END AS side, count(*) AS n
      FROM (SELECT doc_id FROM {d.t('labels')} WHERE quality = 1) a FULL OUTER JOIN (SELECT doc_id FROM {d.t('labels')} WHERE toxic = 0) b ON a.doc_id = b.doc_id
      GROUP BY CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'left' ELSE 'right' END"""


@shared("dj28_manifest_equality")
def _(d):
    a = f"SELECT CAST(o_orderkey AS {'STRING' if d.spark else 'VARCHAR'}) AS k, o_orderstatus AS s FROM {d.t('orders')}"
    b = f"SELECT CAST(file_id AS {'STRING' if d.spark else 'VARCHAR'}), language FROM {d.t('files')}"
    return f"SELECT 'missing' AS side, count(*) AS n FROM ({a} EXCEPT {b}) x UNION ALL SELECT 'extra', count(*) FROM ({b} EXCEPT {a}) y"


@shared("dj5_disjointness")
def _(d):
    """The first rule that drops a document: empty, seen before, shares a text with the benchmark, its group, long."""
    bench = f"SELECT {d.sha('text')} FROM {d.t('benchmark')}"
    return f"""SELECT reason, language, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM (SELECT *, CASE WHEN n_bytes = 0 THEN 'unusable' WHEN seen > 1 THEN 'duplicate' WHEN sha256 IN ({bench}) THEN 'evaluation'
        WHEN grp IN ('src3', 'src7') THEN 'group' WHEN n_bytes > 20000 THEN 'too_large' ELSE 'kept' END AS reason
      FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS seen FROM {d.t('manifest')}) a) b GROUP BY reason, language"""


# -- metrics ---------------------------------------------------------------------------------------


@shared("e2_zero_safe_metrics")
def _(d):
    return f"SELECT file_id, tp, fp, fn, {_metrics(d)} FROM {d.t('per_file')}"


@shared("e3_undefined_metrics")
def _(d):
    return f"""SELECT file_id, round({d.undefined('tp', '(tp + fp)')}, 9) AS precision, round({d.undefined('tp', '(tp + fn)')}, 9) AS recall,
      CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN CASE WHEN tp = 0 THEN CAST(0 AS DOUBLE) ELSE round({d.undefined('2 * tp', '(2 * tp + fp + fn)')}, 9) END END AS f1 FROM {d.t('per_file')}"""


@shared("e4_epsilon_f1")
def _(d):
    return f"SELECT file_id, round(CAST(2 * tp AS DOUBLE) / greatest(CAST(0.000000000001 AS DOUBLE), CAST(2 * tp + fp + fn AS DOUBLE)), 9) AS f1 FROM {d.t('per_file')}"


@shared("e5_micro_pooling")
def _(d):
    return f"SELECT language, n_files, tp, fp, fn, {_metrics(d)} FROM (SELECT language, count(*) AS n_files, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM {d.t('per_file')} GROUP BY language) q"


def _strata(d):
    return f"""SELECT DISTINCT language, 'global' AS axis, 'all' AS stratum FROM {d.t('starts')} UNION SELECT DISTINCT language, 'ast_depth', CAST(depth AS {'STRING' if d.spark else 'VARCHAR'}) FROM {d.t('starts')}
      UNION SELECT DISTINCT language, 'node_type', node_type FROM {d.t('starts')}"""


@shared("e7_strata_predeclaration")
def _(d):
    return _strata(d)


@shared("e6_grouping_sets")
def _(d):
    """Every file counts in every stratum of its language, targets there or not; the precision's
    denominator is all of a language's predictions."""
    s = "STRING" if d.spark else "VARCHAR"
    marked = f"SELECT t.file_id, t.language, t.depth, t.node_type, CASE WHEN p.off IS NULL THEN 0 ELSE 1 END AS hit, {d.series(0, 2)} AS j FROM {d.t('starts')} t LEFT JOIN {d.t('predictions')} p ON p.file_id = t.file_id AND p.off = t.off"
    axes = f"SELECT language, CASE j WHEN 0 THEN 'global' WHEN 1 THEN 'ast_depth' ELSE 'node_type' END AS axis, CASE j WHEN 0 THEN 'all' WHEN 1 THEN CAST(depth AS {s}) ELSE node_type END AS stratum, hit FROM ({marked}) m"
    return f"""SELECT axis, language, stratum, n_files, tp, fp, fn, {_metrics(d)} FROM (
      SELECT h.axis, h.language, h.stratum, f.n_files, h.tp, coalesce(p.n, 0) - h.tp AS fp, h.n - h.tp AS fn
      FROM (SELECT axis, language, stratum, count(*) AS n, CAST(sum(hit) AS BIGINT) AS tp FROM ({axes}) x GROUP BY axis, language, stratum) h
      JOIN (SELECT language, count(*) AS n_files FROM {d.t('files')} GROUP BY language) f ON f.language = h.language
      LEFT JOIN (SELECT language, count(*) AS n FROM {d.t('predictions')} GROUP BY language) p ON p.language = h.language) q"""


@shared("e8_exploratory_axes")
def _(d):
    s = "STRING" if d.spark else "VARCHAR"
    return f"""SELECT axis, stratum, count(*) AS n_targets FROM (SELECT 'all' AS axis, 'all' AS stratum FROM {d.t('starts')} UNION ALL SELECT 'depth', CAST(depth AS {s}) FROM {d.t('starts')}
      UNION ALL SELECT 'node_type', node_type FROM {d.t('starts')}) q GROUP BY axis, stratum"""


@shared("e9_language_rollup")
def _(d):
    return f"SELECT coalesce(language, 'all') AS language, {_metrics(d)} FROM (SELECT language, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM {d.t('per_file')} GROUP BY ROLLUP (language)) q"


@shared("e15_macro_average")
def _(d):
    return f"SELECT language, round(avg(recall), 9) AS macro_recall, count(*) AS n_types FROM (SELECT t.language, t.node_type, CAST(count(p.off) AS DOUBLE) / count(*) AS recall FROM {d.t('starts')} t LEFT JOIN {d.t('predictions')} p ON p.file_id = t.file_id AND p.off = t.off GROUP BY t.language, t.node_type) q GROUP BY language"


@shared("e17_medians")
def _(d):
    return f"SELECT language, CAST({d.pct('n_bytes', 0.5)} AS DOUBLE) AS median_bytes, CAST({d.pct('n_patches', 0.5)} AS DOUBLE) AS median_patches FROM {d.t('files')} GROUP BY language"


@shared("e18_linear_quantiles")
def _(d):
    return f"SELECT o_orderstatus AS language, round({d.pct('o_totalprice', 0.025)}, 6) AS low, round({d.pct('o_totalprice', 0.975)}, 6) AS high FROM {d.t('orders')} GROUP BY o_orderstatus"


@shared("e19_value_counts")
def _(d):
    return f"""SELECT node_type, language, n, round(CAST(n AS DOUBLE) / total, 9) AS share FROM (SELECT node_type, language, n, sum(n) OVER (PARTITION BY language) AS total, row_number() OVER (PARTITION BY language ORDER BY n DESC, node_type) AS r
      FROM (SELECT node_type, language, count(*) AS n FROM {d.t('nodes')} GROUP BY node_type, language) a) b WHERE r <= 5"""


@shared("e23_shared_starts")
def _(d):
    return f"SELECT file_id, start_byte, count(*) AS n, min(depth) AS min_depth FROM {d.t('nodes')} GROUP BY file_id, start_byte HAVING count(*) > 1"


@shared("e24_group_transform")
def _(d):
    return f"SELECT file_id, pos, min(len) OVER (PARTITION BY file_id) AS shortest, round(avg(len) OVER (PARTITION BY file_id), 6) AS mean_len FROM {d.t('tiles')}"


@shared("e25_group_statistics")
def _(d):
    return f"SELECT language, count(*) AS n_groups, CAST({d.pct('n', 0.5)} AS DOUBLE) AS median_size, max(n) AS largest FROM (SELECT language, grp, count(*) AS n FROM {d.t('manifest')} GROUP BY language, grp) q GROUP BY language"


@shared("e26_shares")
def _(d):
    return f"SELECT language, round(CAST(sum(CASE WHEN n_bytes < 1000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS share_rows, round(CAST(sum(CASE WHEN n_bytes < 1000 THEN n_bytes ELSE 0 END) AS DOUBLE) / sum(n_bytes), 9) AS share_bytes FROM {d.t('manifest')} GROUP BY language"


@shared("e27_coincidence")
def _(d):
    return f"""SELECT p.trigger, count(*) AS n, round(CAST(count(w.doc_id) AS DOUBLE) / count(*), 9) AS at_word FROM {d.t('patches')} p
      LEFT JOIN {d.t('words')} w ON w.doc_id = p.doc_id AND w.start_byte = p.start_byte GROUP BY p.trigger"""


@shared("e28_agreement")
def _(d):
    return f"SELECT event_type, round(corr(value, k), 6) AS r, round(avg(abs(value - k)), 6) AS mae, count(*) AS n FROM (SELECT event_type, value, CAST({d.json('props', 'k')} AS DOUBLE) AS k FROM {d.t('events')}) q GROUP BY event_type"


@shared("e29_jaccard")
def _(d):
    return f"""SELECT language, round(CAST(sum(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END) AS DOUBLE) / greatest(1, count(*)), 9) AS jaccard, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS xor FROM
      (SELECT file_id, language, off, max(a) AS a, max(b) AS b FROM (SELECT file_id, language, off, 1 AS a, 0 AS b FROM {d.t('predictions')} UNION ALL SELECT file_id, language, off, 0, 1 FROM {d.t('starts')}) u GROUP BY file_id, language, off) q GROUP BY language"""


@shared("e31_conditional_means")
def _(d):
    return f"SELECT language, round(avg(CASE WHEN flag = 'R' THEN len END), 9) AS unsafe, round(avg(CASE WHEN flag <> 'R' THEN len END), 9) AS safe, round(stddev_samp(len), 6) AS sd FROM {d.t('tiles')} GROUP BY language"


@shared("e32_corrected_ratios")
def _(d):
    return f"SELECT language, round((r - r0) / (1 - r0), 9) AS kappa, round(1 / r0, 9) AS cap FROM (SELECT o.language, CAST(sum(o.tp) AS DOUBLE) / sum(o.tp + o.fn) AS r, max(n.r0) AS r0 FROM {d.t('per_file')} o JOIN (SELECT c.language, CAST(sum(c.tp) AS DOUBLE) / sum(p.tp + p.fn) AS r0 FROM {d.t('null_counts')} c JOIN {d.t('per_file')} p ON c.file_id = p.file_id GROUP BY c.language) n ON n.language = o.language GROUP BY o.language) q"


@shared("e33_expected_null")
def _(d):
    return f"""SELECT language, round(sum(h0 * den / 2), 6) AS null_tp, CAST(sum(den) AS BIGINT) AS den FROM (SELECT p.language, (p.tp + p.fp) + (p.tp + p.fn) AS den, {d.ratio('2 * c.m', '(2 * p.tp + p.fp + p.fn)')} AS h0
      FROM {d.t('per_file')} p JOIN (SELECT file_id, avg(CAST(tp AS DOUBLE)) AS m FROM {d.t('null_counts')} GROUP BY file_id) c ON p.file_id = c.file_id) q GROUP BY language"""


@shared("e34_drop_accounting")
def _(d):
    return f"""SELECT split, reason, count(*) AS n, count(DISTINCT grp) AS n_groups FROM (SELECT split, grp, CASE WHEN n_bytes < 300 THEN 'short' WHEN n_bytes > 3000 THEN 'long' ELSE 'kept' END AS reason FROM {d.t('manifest')}) q GROUP BY split, reason"""


@shared("e35_build_summary")
def _(d):
    return f"SELECT language, flag AS condition, count(*) AS n_edits, CAST(sum(len) AS BIGINT) AS n_bytes, CAST(sum(CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped FROM {d.t('tiles')} GROUP BY language, flag"


@shared("e36_file_set_digest")
def _(d):
    return f"SELECT language, {d.sha(d.joined('file_id', 'chr(10)', 'file_id'))} AS digest, count(*) AS n FROM {d.t('manifest')} GROUP BY language"


@shared("e38_byte_balance")
def _(d):
    return f"""SELECT language, n_bytes, round(CAST(n_bytes AS DOUBLE) / total, 9) AS share, round(CAST(1 AS DOUBLE) / n_bytes, 15) AS weight FROM (SELECT language, n_bytes, sum(n_bytes) OVER () AS total FROM (SELECT language, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM {d.t('manifest')} GROUP BY language) a) b"""


@query("e37_record_digest", lambda d: "SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_name\":\"' || c_name || '\"}') AS digest FROM customer")
def record_digest(spark, sf):
    from spanalign.functions import distributions

    return frame(spark, sf, "customer").select("c_custkey", distributions.record_digest("c_name", "c_custkey", "c_mktsegment").alias("digest"))


@query("hs31_divergence", lambda d: """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), z AS (SELECT vec_id, x, list_max(x) + ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) AS z FROM v),
  q AS (SELECT vec_id, list_transform(x, lambda y: y - z) AS lq FROM z), p AS (SELECT vec_id, lq, len(lq) AS n FROM q)
  SELECT vec_id, round(-list_sum(lq) / n, 9) AS cross_entropy, round(-ln(n) - list_sum(lq) / n, 9) AS divergence FROM p""")
def divergence(spark, sf):
    """Of the even distribution from a softmax of each vector."""
    from spanalign.functions import distributions as D

    rows = frame(spark, sf, "embeddings").select("vec_id", D.log_softmax("embedding").alias("q")).withColumn("p", F.transform("q", lambda x: F.lit(1.0) / F.size("q")))
    return rows.select("vec_id", F.round(D.cross_entropy("p", "q"), 9).alias("cross_entropy"), F.round(D.divergence("p", "q"), 9).alias("divergence"))


@query("hs35_same_bits", lambda d: "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice = round(o_totalprice, 1)) AS n_same FROM orders GROUP BY o_orderstatus")
def same_bits(spark, sf):
    from spanalign.functions import distributions as D

    rows = frame(spark, sf, "orders").withColumn("r", F.round("o_totalprice", 1).cast("double")).withColumn("v", F.col("o_totalprice").cast("double"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(D.same_bits("v", "r")).alias("n_same"))


# -- attribution -----------------------------------------------------------------------------------


@query("f6_outermost_v1", lambda d: f"SELECT * FROM {d.t('starts')}")
def outermost_v1(spark, sf):
    nodes = frame(spark, sf, "nodes").where("depth > 0 AND node_type <> 'module' AND end_byte > start_byte AND start_byte > 0 AND start_byte < n_bytes")
    order = [F.col("depth").asc(), (F.col("end_byte") - F.col("start_byte")).desc(), F.col("node_type").asc(), F.col("node_id").asc()]
    return matching.outermost(nodes, "start_byte", order).select("file_id", "language", "node_type", "depth", F.col("start_byte").alias("off"))


@query("f7_outermost_exploratory", lambda d: f"SELECT file_id, end_byte AS off, node_type, depth FROM (SELECT *, row_number() OVER (PARTITION BY file_id, end_byte ORDER BY depth, start_byte, node_type) AS r FROM {d.t('nodes')} WHERE end_byte > start_byte) WHERE r = 1")
def outermost_exploratory(spark, sf):
    nodes = frame(spark, sf, "nodes").where("end_byte > start_byte")
    order = [F.col("depth").asc(), F.col("start_byte").asc(), F.col("node_type").asc()]
    return matching.outermost(nodes, "end_byte", order).select("file_id", F.col("end_byte").alias("off"), "node_type", "depth")


@shared("f6_span_attribution_documents")
def _(d):
    return f"""SELECT node_type, depth, count(*) AS n, CAST(sum(start_byte) AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start_byte ORDER BY depth, start_byte - end_byte, node_type) AS r FROM {d.t('spans')}) q WHERE r = 1 GROUP BY node_type, depth"""


@shared("f23_depth_decile")
def _(d):
    return f"""SELECT decile, capped, count(*) AS n FROM (SELECT least(9, {d.int_div('10 * depth', '(max(depth) OVER (PARTITION BY file_id) + 1)')}) AS decile, least(depth, 8) AS capped FROM {d.t('starts')}) q GROUP BY decile, capped"""


@shared("c4_primary_targets")
def _(d):
    return f"SELECT file_id, count(*) AS n FROM {d.t('nodes')} WHERE depth > 0 AND lower(node_type) NOT IN ('root', 'program', 'translation_unit', 'module', 'document', 'paragraph') AND end_byte > start_byte AND start_byte > 0 AND start_byte < n_bytes GROUP BY file_id"


@shared("c5_interior_entropy")
def _(d):
    return f"SELECT file_id, off FROM {d.t('predictions')}"


@shared("c6_interior_filter")
def _(d):
    return f"SELECT DISTINCT n.file_id, n.start_byte AS off FROM {d.t('nodes')} n WHERE n.start_byte > 0 AND n.start_byte < n.n_bytes"


@shared("c12_overlap_predicate")
def _(d):
    return f"SELECT count(*) AS n FROM {_clipped(d)} c"


@shared("documents_alignment")
def _(d):
    """Patch starts of the documents against the starts of their spans, by language."""
    return f"""SELECT lang, tp, n_pred, n_targets, round({d.ratio('2 * tp', '(n_pred + n_targets)')}, 9) AS f1 FROM (SELECT o.lang, CAST(sum(CASE WHEN q.a = 1 AND q.b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(q.a) AS BIGINT) AS n_pred, CAST(sum(q.b) AS BIGINT) AS n_targets FROM
      (SELECT doc_id, off, max(a) AS a, max(b) AS b FROM (SELECT doc_id, start_byte AS off, 1 AS a, 0 AS b FROM {d.t('patches')} WHERE start_byte > 0 UNION ALL SELECT doc_id, start_byte, 0, 1 FROM {d.t('spans')} WHERE start_byte > 0) u GROUP BY doc_id, off) q
      JOIN (SELECT doc_id, lang FROM {d.t('documents')}) o ON o.doc_id = q.doc_id GROUP BY o.lang) r"""
