"""Queries: selection, sampling, splits, set operations, validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.functions import tables
from spanalign.operators import guards, sampling, validate
from spanalign.plans.bindings import TAU
from spanalign.plans.registry import SPARK, frame, query, run_sql, shared
from spanalign.sources import readers

# -- selection, sampling, splits ---------------------------------------------------------------------


@shared("c1_select_files")
def _(d):
    return f"SELECT doc_id, language, n_bytes FROM {d.t('manifest')} WHERE language IN ('en', 'de') AND split = 'train' AND n_bytes > 0"


@shared("c2_first_per_domain")
def _(d):
    return f"SELECT doc_id, language FROM (SELECT doc_id, language, row_number() OVER (PARTITION BY language ORDER BY n_bytes, file_id, doc_id) AS r FROM {d.t('manifest')}) q WHERE r <= 5"


@shared("c7_tristate_filter")
def _(d):
    return f"SELECT m.doc_id FROM {d.t('manifest')} m LEFT JOIN {d.t('labels')} l ON m.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0"


@shared("c8_range_from_other")
def _(d):
    return f"SELECT doc_id, n_bytes FROM {d.t('manifest')} WHERE language <> 'en' AND n_bytes BETWEEN (SELECT min(n_bytes) FROM {d.t('manifest')} WHERE language = 'en') AND (SELECT max(n_bytes) FROM {d.t('manifest')} WHERE language = 'en')"


@shared("c9_length_filter")
def _(d):
    return f"SELECT doc_id, n_bytes FROM {d.t('manifest')} WHERE n_bytes BETWEEN 300 AND 3000"


@shared("c10_usable_bytes")
def _(d):
    return f"SELECT doc_id FROM {d.t('manifest')} WHERE n_bytes > 0 AND {'instr(text, chr(0))' if d.spark else 'instr(text, chr(0))'} = 0"


@shared("c11_statement_units")
def _(d):
    return f"SELECT file_id, node_id FROM {d.t('nodes')} WHERE node_type IN ('AF', 'RO') AND parent_type = 'block' AND end_byte > start_byte"


@shared("c13_subset_ids")
def _(d):
    return f"SELECT doc_id FROM {d.t('manifest')} WHERE split = 'val' AND (language <> 'en' OR n_bytes < 8192) OR doc_id IN (SELECT doc_id FROM {d.t('labels')} WHERE toxic = 1)"


@shared("c14_manifest_projection")
def _(d):
    return f"""SELECT doc_id, concat('sample-', file_id) AS sample_id, CASE language WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'other' END AS language_name, n_bytes AS byte_length,
      CASE WHEN grp = 'src0' THEN 'unknown' ELSE 'known' END AS license_status, sha256 AS text_sha256 FROM {d.t('manifest')}"""


@query("f8_keep_first", lambda d: f"SELECT doc_id, sha256 FROM (SELECT doc_id, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS r FROM {d.t('manifest')}) WHERE r = 1")
def keep_first(spark, sf):
    """First of equal texts: a minimum by hash, summed before it is dealt, so copies cost nothing."""
    return sampling.keep_first(frame(spark, sf, "documents"), "doc_id", "text")


@shared("f9_fixed_prefix_split")
def _(d):
    return f"SELECT doc_id, CASE WHEN r <= 10 THEN 'calib' WHEN r <= 100 THEN 'main' ELSE 'rest' END AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY language ORDER BY doc_id) AS r FROM {d.t('manifest')}) q"


@query("f10_hash_ranked_split", lambda d: f"""SELECT doc_id, language, CASE WHEN r <= ceil(n / 5.0) THEN 'calibration' ELSE 'test' END AS split FROM
  (SELECT doc_id, language, row_number() OVER (PARTITION BY language ORDER BY {d.key("'20260927'", 'language', 'doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY language) AS n FROM {d.t('manifest')})""")
def hash_ranked_split(spark, sf):
    rows = frame(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"))
    return sampling.hash_split(rows, "doc_id", "language", seed=20260927)


@shared("f11_hash_rank_top")
def _(d):
    return f"SELECT doc_id, language FROM (SELECT doc_id, language, row_number() OVER (PARTITION BY language ORDER BY {d.key(chr(39) + '42' + chr(39), 'doc_id')}) AS r FROM {d.t('manifest')}) q WHERE r <= 20"


@shared("f12_group_split")
def _(d):
    return f"SELECT grp, split, count(*) AS n FROM {d.t('manifest')} GROUP BY grp, split"


@query("f13_rank_prefix_sample", lambda d: f"SELECT doc_id, rnk FROM (SELECT doc_id, {d.hash32('sha256')} AS rnk FROM {d.t('manifest')}) ORDER BY rnk, doc_id LIMIT 100")
def rank_prefix_sample(spark, sf):
    """A sample of 100 by the lowest hashes: a top-k of one number, not a sort."""
    from spanalign.functions.bytesops import hash32

    return frame(spark, sf, "documents").select("doc_id", hash32(F.sha2("text", 256)).alias("rnk")).orderBy("rnk", "doc_id").limit(100)


@shared("f14_min_rank_groups")
def _(d):
    lowest = f"SELECT grp FROM (SELECT grp, row_number() OVER (ORDER BY rnk, grp) AS r FROM (SELECT grp, min({d.hash32('sha256')}) AS rnk FROM {d.t('manifest')} GROUP BY grp) a) b WHERE r <= 5"
    return f"SELECT doc_id, grp FROM {d.t('manifest')} WHERE grp IN ({lowest})"


@shared("f15_first_n_per_group")
def _(d):
    return f"SELECT doc_id, grp FROM (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY file_id, doc_id) AS r FROM {d.t('manifest')}) q WHERE r <= 3"


@query("f24_lpt_shards")
def lpt_shards(spark, sf):
    """Longest first, each to the least loaded of four shards, from summed sizes of groups."""
    rows = frame(spark, sf, "manifest").groupBy("grp").agg(F.sum("n_bytes").alias("n_bytes"))
    return sampling.lpt(rows, "grp", "n_bytes", 4)


@shared("f25_round_robin")
def _(d):
    return f"SELECT doc_id, (row_number() OVER (PARTITION BY language ORDER BY file_id, doc_id) - 1) % 4 AS shard FROM {d.t('manifest')}"


@shared("f26_contiguous_chunks")
def _(d):
    return f"SELECT language, chunk, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT language, doc_id, ntile(4) OVER (PARTITION BY language ORDER BY doc_id) AS chunk FROM {d.t('manifest')}) q GROUP BY language, chunk"


@shared("i38_balanced_sampling")
def _(d):
    """Draws by cumulative bytes, as many of each language: an as-of join on the running sum, by 60-bit numbers."""
    w = f"SELECT doc_id, n_bytes, language, CAST(sum(n_bytes) OVER (PARTITION BY language ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi, CAST(sum(n_bytes) OVER (PARTITION BY language) AS BIGINT) AS total FROM {d.t('manifest')}"
    draws = f"SELECT language, j, {d.hash60(d.key(chr(39) + '13' + chr(39), 'language', 'j'))} AS u FROM (SELECT language, {d.series(0, 49)} AS j FROM (SELECT DISTINCT language FROM {d.t('manifest')}) l) x"
    return f"SELECT x.language, x.j, w.doc_id FROM ({draws}) x JOIN ({w}) w ON w.language = x.language AND x.u % w.total >= w.hi - w.n_bytes AND x.u % w.total < w.hi"


# -- sort, limit, set operations -----------------------------------------------------------------------


@shared("g1_canonical_sort")
def _(d):
    return f"SELECT doc_id, row_number() OVER (PARTITION BY grp ORDER BY CASE language WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, file_id, doc_id) AS place FROM {d.t('manifest')}"


@shared("g2_mixed_sort")
def _(d):
    return f"SELECT file_id, node_id, row_number() OVER (PARTITION BY file_id ORDER BY depth ASC, end_byte DESC, node_type ASC, node_id ASC) AS place FROM {d.t('nodes')}"


@shared("g3_stratum_order")
def _(d):
    t = "try_cast(s AS INT)"
    return f"SELECT s, row_number() OVER (ORDER BY coalesce({t}, 1000), s) AS place FROM (SELECT DISTINCT CAST(depth AS {'STRING' if d.spark else 'VARCHAR'}) AS s FROM {d.t('nodes')} UNION SELECT DISTINCT node_type FROM {d.t('nodes')}) q"


@shared("g4_distinct_offsets")
def _(d):
    return f"SELECT file_id, {d.joined('start_byte', chr(39) + ',' + chr(39), 'start_byte')} AS offsets FROM (SELECT DISTINCT file_id, start_byte FROM {d.t('nodes')}) q GROUP BY file_id"


@query("g6_top_20", lambda d: f"SELECT lower(piece) AS word, count(*) AS n FROM {d.t('words')} GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def top_20(spark, sf):
    return frame(spark, sf, "words").groupBy(F.lower("piece").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("g5_first_kept", lambda d: f"SELECT doc_id FROM {d.t('manifest')} WHERE n_bytes BETWEEN 300 AND 3000 ORDER BY doc_id LIMIT 50")
def first_kept(spark, sf):
    return frame(spark, sf, "manifest").where("n_bytes BETWEEN 300 AND 3000").select("doc_id").orderBy("doc_id").limit(50)


@shared("g13_union_by_key")
def _(d):
    return f"SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT language AS k, count(*) AS n FROM {d.t('starts')} GROUP BY language UNION ALL SELECT language, count(*) FROM {d.t('ends')} GROUP BY language) q GROUP BY k"


@shared("g14_intersection")
def _(d):
    return f"SELECT file_id, off FROM {d.t('starts')} INTERSECT SELECT file_id, off FROM {d.t('ends')}"


@shared("g15_bag_difference")
def _(d):
    return f"SELECT file_id, start_byte AS off FROM {d.t('nodes')} EXCEPT ALL SELECT file_id, end_byte FROM {d.t('nodes')}"


@shared("g16_symmetric_difference")
def _(d):
    a, b = f"SELECT file_id, off FROM {d.t('starts')}", f"SELECT file_id, off FROM {d.t('predictions')}"
    return f"SELECT 'a' AS side, file_id, off FROM (({a}) EXCEPT ({b})) x UNION ALL SELECT 'b', file_id, off FROM (({b}) EXCEPT ({a})) y"


@shared("g17_duplicates")
def _(d):
    return f"SELECT sha256, count(*) AS n, min(doc_id) AS first FROM {d.t('manifest')} GROUP BY sha256 HAVING count(*) > 1"


@shared("g19_contiguity")
def _(d):
    return f"SELECT file_id, count(*) AS n_overlaps FROM (SELECT file_id, start_byte, max(end_byte) OVER (PARTITION BY file_id ORDER BY start_byte, end_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {d.t('nodes')} WHERE end_byte > start_byte) q WHERE start_byte < before GROUP BY file_id"


@shared("g12_newest")
def _(d):
    return f"SELECT event_type, {d.max_by('event_id', 'ts')} AS newest FROM {d.t('events')} GROUP BY event_type"


# -- validators ----------------------------------------------------------------------------------------


def _problems(d):
    tiles = f"SELECT file_id, pos, start_byte, end_byte, n_bytes, reason, n_patches, lag(end_byte) OVER (PARTITION BY file_id ORDER BY pos) AS before FROM {d.t('tiles')}"
    return f"""SELECT rule, count(*) AS n FROM (
      SELECT 'gap' AS rule FROM ({tiles}) a WHERE coalesce(before, 0) <> start_byte
      UNION ALL SELECT 'empty' FROM ({tiles}) b WHERE end_byte <= start_byte
      UNION ALL SELECT 'eof' FROM ({tiles}) c WHERE (reason = 'eof') <> (pos = n_patches)
      UNION ALL SELECT 'length' FROM ({tiles}) e WHERE pos = n_patches AND end_byte <> n_bytes
      UNION ALL SELECT 'long' FROM ({tiles}) f WHERE end_byte - start_byte > 45) q GROUP BY rule"""


@query("c17_sample_problems", _problems)
def sample_problems(spark, sf):
    return validate.tiling_problems(frame(spark, sf, "tiles"), longest=45).groupBy("rule").agg(F.count("*").alias("n"))


@query("c18_boundary_problems", lambda d: f"""SELECT rule, count(*) AS n FROM (SELECT 'score_not_above' AS rule FROM {d.t('patches')} WHERE trigger = 'entropy' AND CAST(score AS DOUBLE) <= 2.05
  UNION ALL SELECT 'init_not_zero' FROM {d.t('patches')} WHERE (trigger = 'init') <> (start_byte = 0) UNION ALL SELECT 'long' FROM {d.t('patches')} WHERE patch_length > 12) GROUP BY rule""")
def boundary_problems(spark, sf):
    return validate.boundary_problems(frame(spark, sf, "patches"), tau=2.05, longest=12).groupBy("rule").agg(F.count("*").alias("n"))


@query("c19_entropy_problems", lambda d: "SELECT vec_id, count(*) AS n FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x < -0.2 OR x > 0.2 OR isnan(x) GROUP BY vec_id")
def entropy_problems(spark, sf):
    bad = F.filter("embedding", lambda x: (x < -0.2) | (x > 0.2) | F.isnan(x))
    return frame(spark, sf, "embeddings").select("vec_id", F.size(bad).cast("long").alias("n")).where("n > 0")


@shared("c20_registry_problems")
def _(d):
    return f"SELECT 'duplicate' AS rule, count(*) AS n FROM (SELECT user_id, event_type FROM {d.t('series')} GROUP BY user_id, event_type HAVING count(*) > 15) a UNION ALL SELECT 'unknown_run', count(*) FROM {d.t('series')} s WHERE NOT EXISTS (SELECT 1 FROM {d.t('customer')} c WHERE c.c_custkey = s.user_id)"


def _damaged(d):
    """The documents' boundary table with faults in some groups of documents."""
    return f"""SELECT doc_id, CASE WHEN doc_id % 11 = 1 THEN patch_index + 1 ELSE patch_index END AS patch_index,
      CASE WHEN doc_id % 11 = 2 AND patch_index = 1 THEN start_byte + 1 WHEN doc_id % 11 = 9 AND patch_index = 2 THEN 0 ELSE start_byte END AS start_byte,
      CASE WHEN doc_id % 11 = 3 AND patch_index = 2 THEN 0 ELSE patch_length END AS patch_length,
      CASE WHEN doc_id % 11 = 4 AND patch_index = 3 THEN 'length_cap' WHEN doc_id % 11 = 6 AND patch_index = 1 THEN 'other' ELSE trigger END AS trigger,
      CASE WHEN doc_id % 11 = 5 AND patch_index > 0 THEN CAST(0 AS FLOAT) WHEN doc_id % 11 = 8 AND patch_index = 1 THEN NULL ELSE score END AS score
      FROM {d.t('patches')} WHERE NOT (doc_id % 11 = 7 AND patch_index = 0) AND NOT (doc_id % 22 = 10)"""


_FILES = "SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes FROM "


def _boundary_sql(d):
    found = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule FROM y WHERE {r}" for k, r in validate.boundary_rules(TAU, 12).items())
    order = "PARTITION BY doc_id ORDER BY patch_index NULLS LAST, start_byte NULLS FIRST"
    return f"""WITH r AS ({_damaged(d)}), f AS ({_FILES} {d.t('manifest')}),
      x AS (SELECT coalesce(r.doc_id, f.doc_id) AS doc_id, patch_index, start_byte, patch_length, trigger, score, n_bytes, r.doc_id IS NOT NULL AS has, f.doc_id IS NOT NULL AS known FROM r FULL JOIN f ON r.doc_id = f.doc_id),
      y AS (SELECT *, row_number() OVER w AS place, lag(start_byte) OVER w AS before, lead(start_byte) OVER w AS after, lag(patch_length) OVER w AS before_length, lead(has) OVER w IS NULL AS last,
        sum(patch_length) OVER ({order} ROWS UNBOUNDED PRECEDING) AS total FROM x WINDOW w AS ({order}))
      SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({found}) q GROUP BY rule"""


@query("c18_boundary_invariants", _boundary_sql)
def boundary_invariants(spark, sf):
    """All rules of a boundary table against one with faults."""
    files = run_sql(spark, sf, f"{_FILES} {{manifest}}")
    found = validate.boundary_table_problems(run_sql(spark, sf, _damaged(SPARK)), files, TAU, 12)
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("c19_score_rules", lambda d: """SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN embedding IS NULL THEN 'missing' END, CASE WHEN len(embedding) <> n THEN 'length' END, CASE WHEN len(list_filter(embedding, lambda x: x < 0)) > 0 THEN 'negative' END,
  CASE WHEN len(list_filter(embedding, lambda x: x > 0.2)) > 0 THEN 'above' END]) AS rule FROM (SELECT *, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE len(embedding) END AS n FROM embeddings) e) q WHERE rule IS NOT NULL GROUP BY rule""")
def score_rules(spark, sf):
    """Series against the length that they should have, and the range of scores."""
    rows = frame(spark, sf, "embeddings").withColumn("n", F.expr("CASE WHEN vec_id % 5 = 0 THEN 1 ELSE size(embedding) END"))
    return validate.score_problems(rows, "embedding", "n", 0.2, "vec_id").groupBy("rule").agg(F.count("*").alias("n"))


def _summaries(d):
    """Bytes per patch of each document, with a fault in some."""
    def off(k, by):
        return f"CASE WHEN doc_id % 13 = {k} THEN {by} ELSE 0 END"

    return f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_patches, CAST(sum(patch_length) AS BIGINT) AS n_bytes, avg(patch_length) + {off(1, 0.5)} AS mean_bpp, var_pop(patch_length) + {off(2, 1000000)} AS var_bpp,
      min(patch_length) + {off(3, 1000000)} AS min_bpp, max(patch_length) AS max_bpp, sum(CASE WHEN trigger = 'init' THEN 1 ELSE 0 END) + {off(4, 1)} AS n_init,
      sum(CASE WHEN trigger = 'entropy' THEN 1 ELSE 0 END) AS n_entropy, sum(CASE WHEN trigger = 'length_cap' THEN 1 ELSE 0 END) AS n_length_cap FROM {d.t('patches')} GROUP BY doc_id"""


def _summary_sql(d):
    found = " UNION ALL ".join(f"SELECT '{k}' AS rule FROM s WHERE {r}" for k, r in validate.SUMMARY_RULES.items())
    return f"WITH s AS ({_summaries(d)}) SELECT rule, count(*) AS n FROM ({found}) q GROUP BY rule"


@query("c20_summary_rules", _summary_sql)
def summary_rules(spark, sf):
    """Summaries whose numbers contradict each other."""
    return validate.summary_problems(run_sql(spark, sf, _summaries(SPARK))).groupBy("rule").agg(F.count("*").alias("n"))


def _group_digests(d, recorded):
    """Digests by language; the record lacks one and holds another one's with a fault."""
    text = "STRING" if d.spark else "VARCHAR"
    total = f"CAST(coalesce(sum(n_bytes), 0) AS BIGINT) + {'''CASE WHEN language = 'de' THEN 1 ELSE 0 END''' if recorded else 0}"
    digest = d.sha(f"concat(CAST(count(*) AS {text}), ':', CAST({total} AS {text}))")
    return f"SELECT language AS name, {digest} AS digest FROM {d.t('manifest')} WHERE language <> '{'en' if recorded else 'fr'}' GROUP BY language"


@query("c24_guard_problems", lambda d: f"""SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'unknown' ELSE 'changed' END AS problem
  FROM ({_group_digests(d, True)}) a FULL JOIN ({_group_digests(d, False)}) b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.digest <> b.digest""")
def guard_problems(spark, sf):
    """What a run that rests on a frozen record would be refused for."""
    return guards.frozen_problems(*(run_sql(spark, sf, _group_digests(SPARK, r)) for r in (True, False)))


@query("a16_samples", lambda d: f"SELECT doc_id, domain, n_bytes, n_chars FROM (SELECT m.doc_id, m.language AS domain, m.n_bytes, f.n_chars FROM {d.t('manifest')} m JOIN (SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL) f ON m.doc_id = f.doc_id WHERE m.split = 'train' AND m.language IN ('en', 'de') ORDER BY m.doc_id LIMIT 100) q")
def samples(spark, sf):
    """The first hundred documents of a split and two domains; those without a text are skipped."""
    manifest = frame(spark, sf, "manifest").select("doc_id", F.col("language").alias("domain"), "n_bytes", "split")
    files = frame(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "n_chars")
    return readers.samples(manifest, files, "train", ["en", "de"], 100, "doc_id").select("doc_id", "domain", "n_bytes", "n_chars")


@shared("a17_start_rows")
def _(d):
    """Results by language, with the expected hits that a stored F1 and its denominator imply."""
    f1 = d.ratio("2 * sum(tp)", "sum(2 * tp + fp + fn)")
    return f"SELECT axis, stratum, kind, den, round(f1, 9) AS f1, round(f1 * den / 2, 6) AS expected FROM (SELECT 'language' AS axis, language AS stratum, 'start' AS kind, CAST(sum(2 * tp + fp + fn) AS BIGINT) AS den, {f1} AS f1 FROM {d.t('per_file')} GROUP BY language) q"


@query("b14_table_rows", lambda d: r"""SELECT o_orderpriority, replace(name, '#', '\#') || ' & ' || n || ' & ' || coalesce(CAST(n_late AS VARCHAR), '??') || ' \\' AS latex, '| ' || name || ' | ' || n || ' |' AS markdown,
  '\newcommand{\' || regexp_replace(translate(o_orderpriority, '0123456789', 'abcdefghij'), '[^A-Za-z]', '', 'g') || '}{' || n || '}' AS macro FROM (SELECT o_orderpriority, min(o_orderpriority || '#') AS name, count(*) AS n, nullif(count(*) FILTER (WHERE o_orderstatus = 'none'), 0) AS n_late FROM orders GROUP BY o_orderpriority) q""")
def table_rows(spark, sf):
    """Results as lines of LaTeX, of Markdown and as macros."""
    late = F.expr("nullif(count_if(o_orderstatus = 'none'), 0)")
    rows = frame(spark, sf, "orders").groupBy("o_orderpriority").agg(F.min(F.concat("o_orderpriority", F.lit("#"))).alias("name"), F.count("*").alias("n"), late.alias("n_late"))
    return rows.select("o_orderpriority", tables.latex_row("name", "n", "n_late").alias("latex"), tables.markdown_row("name", "n").alias("markdown"), tables.latex_macro("o_orderpriority", "n").alias("macro"))


@shared("c21_completeness")
def _(d):
    return f"SELECT w.doc_id, count(*) AS n_missing FROM {d.t('words')} w WHERE w.start_byte > 0 AND NOT EXISTS (SELECT 1 FROM {d.t('patches')} p WHERE p.doc_id = w.doc_id AND p.start_byte = w.start_byte) GROUP BY w.doc_id"


@shared("c22_first_out_of_bounds")
def _(d):
    return f"SELECT file_id, min(node_id) AS node_id FROM {d.t('nodes')} WHERE end_byte <= start_byte GROUP BY file_id"


@shared("c15_constant_config")
def _(d):
    return f"SELECT c_mktsegment AS k, count(DISTINCT c_nationkey) AS n_values, count(DISTINCT c_nationkey) = 1 AS constant FROM {d.t('customer')} GROUP BY c_mktsegment"


@shared("c16_record_problems")
def _(d):
    return f"""SELECT rule, count(*) AS n FROM (SELECT 'sample_id' AS rule FROM {d.t('manifest')} WHERE NOT {d.matches('file_id', '^(en|de|fr|es|it)_[0-9a-f]+$')} UNION ALL SELECT 'sha256' FROM {d.t('manifest')} WHERE length(sha256) <> 64
      UNION ALL SELECT 'empty' FROM {d.t('manifest')} WHERE n_bytes < 1) q GROUP BY rule"""


@shared("c23_cross_validation")
def _(d):
    return f"""SELECT m.language, count(*) AS n, round(CAST(sum(CASE WHEN l.n IS NULL THEN 0 ELSE 1 END) AS DOUBLE) / count(*), 9) AS with_lines, round(CAST(sum(CASE WHEN w.n > p.n THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS more_words FROM {d.t('manifest')} m
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM {d.t('lines')} GROUP BY doc_id) l ON l.doc_id = m.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM {d.t('words')} GROUP BY doc_id) w ON w.doc_id = m.doc_id
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM {d.t('patches')} GROUP BY doc_id) p ON p.doc_id = m.doc_id GROUP BY m.language"""


@shared("c25_frozen_reproduction")
def _(d):
    """Recomputed scores against the stored ones to six digits; one of the stored ones is off by a hundredth and has to be found."""
    f1 = f"SELECT language, {d.ratio('2 * sum(tp)', 'sum(2 * tp + fp + fn)')} AS f1 FROM {d.t('per_file')} GROUP BY language"
    stored = f"SELECT language, round(f1, 6) + CASE WHEN language = 'O' THEN 0.01 ELSE 0 END AS f1 FROM ({f1}) s"
    return f"SELECT coalesce(a.language, b.language) AS language, a.language IS NOT NULL AND b.language IS NOT NULL AND abs(a.f1 - b.f1) < 0.000001 AS reproduced FROM ({f1}) a FULL OUTER JOIN ({stored}) b ON a.language = b.language"


@shared("c26_pull_check")
def _(d):
    same = "a.n_bytes <=> b.n_chars" if d.spark else "a.n_bytes IS NOT DISTINCT FROM b.n_chars"
    return f"SELECT CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN {same} THEN 'same' ELSE 'differs' END AS state, count(*) AS n FROM {d.t('manifest')} a FULL OUTER JOIN {d.t('documents')} b ON a.doc_id = b.doc_id GROUP BY CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN {same} THEN 'same' ELSE 'differs' END"


@shared("c27_taxonomy_coverage")
def _(d):
    known = "SELECT 'line' AS node_type UNION ALL SELECT 'word' UNION ALL SELECT 'number' UNION ALL SELECT 'comment'"
    return f"SELECT 'missing' AS side, node_type FROM (SELECT DISTINCT node_type FROM {d.t('spans')} EXCEPT ({known})) a UNION ALL SELECT 'stale', node_type FROM (({known}) EXCEPT SELECT DISTINCT node_type FROM {d.t('spans')}) b"


_KEPT = "(node_type <> 'RF' OR depth <> 3)"
_MOVED = "CASE WHEN depth = 1 AND node_type = 'AF' THEN end_byte + 1 ELSE end_byte END"
_NODE = "file_id, node_id, node_type, parent_type, depth, start_byte"


@query("c28_drift_check", lambda d: f"""WITH a AS (SELECT {_NODE}, end_byte FROM {d.t('nodes')}), b AS (SELECT {_NODE}, {_MOVED} AS end_byte FROM {d.t('nodes')} WHERE {_KEPT})
  SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS n_missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS n_extra, (SELECT count(*) FROM a) AS n_rows""")
def drift_check(spark, sf):
    """A table against one that lost rows and has others moved: bag differences in both directions."""
    nodes = frame(spark, sf, "nodes")
    return validate.bag_difference(nodes.selectExpr(*_NODE.split(", "), "end_byte"), nodes.where(_KEPT).selectExpr(*_NODE.split(", "), f"{_MOVED} AS end_byte"))


@shared("hs4_utf8_valid")
def _(d):
    return f"SELECT count(*) AS n, {'count_if(is_valid_utf8(text))' if d.spark else 'count(text)'} AS n_valid FROM {d.t('documents')}"


@query("hs10_span_problems", lambda d: """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN e > n THEN 'outside' WHEN hs >= '80' AND hs < 'C0' OR he >= '80' AND he < 'C0' THEN 'cuts_character' ELSE 'ok' END AS problem FROM
  (SELECT s, s + 7 AS e, len(h) AS n, h[s + 1] AS hs, coalesce(h[s + 8], '') AS he FROM (SELECT h, unnest(range(0, len(h), 13)) AS s FROM (SELECT regexp_extract_all(hex(encode(text)), '..') AS h FROM documents)))) GROUP BY problem""")
def span_problems(spark, sf):
    """Spans of seven bytes at every thirteenth byte: do they stay on characters?"""
    return validate.span_problems(frame(spark, sf, "documents"), 13, 7).groupBy("problem").agg(F.count("*").alias("n"))


@shared("hs34_is_close")
def _(d):
    return f"SELECT o_orderstatus, count(*) AS n, CAST(sum(CASE WHEN abs(o_totalprice - round(o_totalprice, 1)) <= greatest(0.0000001 * greatest(abs(o_totalprice), abs(round(o_totalprice, 1))), 0.000000001) THEN 1 ELSE 0 END) AS BIGINT) AS n_close FROM {d.t('orders')} GROUP BY o_orderstatus"


@shared("hs36_json_fields")
def _(d):
    return f"SELECT event_type, CAST(sum(CAST({d.json('props', 'k')} AS BIGINT)) AS BIGINT) AS total, count({d.json('props', 'k')}) AS n FROM {d.t('events')} GROUP BY event_type"


@shared("hs37_utc_timestamps")
def _(d):
    f = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")" if d.spark else "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
    return f"SELECT event_id, {f} AS iso FROM {d.t('events')}"


@shared("hs39_license_normalisation")
def _(d):
    return f"SELECT status, n_licenses, count(*) AS n FROM (SELECT CASE WHEN trim(p_type) = '' THEN 'unknown' ELSE 'known' END AS status, {'size(split(p_type, chr(32)))' if d.spark else 'CAST(len(string_split(p_type, chr(32))) AS INT)'} AS n_licenses FROM {d.t('part')}) q GROUP BY status, n_licenses"


# -- the star schema -----------------------------------------------------------------------------------


@shared("star_pricing_summary")
def _(d):
    return f"""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
      FROM {d.t('lineitem')} WHERE l_shipdate <= CAST('2024-12-01' AS DATE) GROUP BY l_returnflag, l_linestatus"""


@shared("star_revenue_by_nation")
def _(d):
    return f"""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM {d.t('lineitem')} JOIN {d.t('orders')} ON l_orderkey = o_orderkey JOIN {d.t('customer')} ON o_custkey = c_custkey
      JOIN {d.t('nation')} ON c_nationkey = n_nationkey JOIN {d.t('region')} ON n_regionkey = r_regionkey GROUP BY r_name, n_name"""


@shared("star_grouping_sets")
def _(d):
    return f"SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {d.t('orders')} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"
