"""Queries: segmentation of documents by scores, baselines, byte functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanalign.functions import bytesops as B
from spanalign.operators import baselines, lexer, offsets, segment
from spanalign.plans.bindings import TAU, duck_patches, duck_scores
from spanalign.plans.registry import frame, query, shared


def _bpp(source: str, key: str = "doc_id") -> str:
    return f"""SELECT {key}, count(*) AS n_patches, CAST(sum(patch_length) AS BIGINT) AS n_bytes, round(avg(patch_length), 6) AS mean_bpp, round(var_pop(patch_length), 6) AS var_bpp,
      min(patch_length) AS min_bpp, max(patch_length) AS max_bpp, round(quantile_cont(patch_length, 0.1), 6) AS p10_bpp, round(quantile_cont(patch_length, 0.5), 6) AS median_bpp,
      round(quantile_cont(patch_length, 0.9), 6) AS p90_bpp, count(*) FILTER (WHERE trigger = 'init') AS n_init, count(*) FILTER (WHERE trigger = 'entropy') AS n_entropy,
      count(*) FILTER (WHERE trigger = 'length_cap') AS n_length_cap FROM ({source}) GROUP BY {key}"""


_BPP = "n_patches n_bytes mean_bpp var_bpp min_bpp max_bpp p10_bpp median_bpp p90_bpp n_init n_entropy n_length_cap".split()


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("e11_bpp_summary", lambda d: _bpp(duck_patches()))
def bpp_summary(spark, sf):
    """Flagship: scores, threshold segmentation and bytes-per-patch statistics of every document."""
    return _rounded(segment.summaries(frame(spark, sf, "documents"), [TAU]).select("doc_id", *_BPP))


@query("f1_threshold_segmentation", lambda d: f"SELECT doc_id, patch_index, start_byte, patch_length, trigger, CAST(score AS DOUBLE) AS score FROM ({duck_patches()})")
def threshold_segmentation(spark, sf):
    return frame(spark, sf, "patches").withColumn("score", F.col("score").cast("double"))


_CAP = 4
_CAPPED = f"""SELECT doc_id, start_byte + {_CAP} * k AS start_byte, CAST(least({_CAP}, patch_length - {_CAP} * k) AS INT) AS patch_length, CASE WHEN k = 0 THEN trigger ELSE 'length_cap' END AS trigger
  FROM (SELECT *, unnest(range((patch_length + {_CAP} - 1) // {_CAP})) AS k FROM ({duck_patches()}))"""


@query("f2_length_cap", lambda d: f"SELECT doc_id, trigger, count(*) AS n, CAST(sum(patch_length) AS BIGINT) AS n_bytes, CAST(max(start_byte) AS BIGINT) AS last_start FROM ({_CAPPED}) GROUP BY doc_id, trigger")
def length_cap(spark, sf):
    out = segment.patches(frame(spark, sf, "documents"), TAU, _CAP)
    return out.groupBy("doc_id", "trigger").agg(F.count("*").alias("n"), F.sum("patch_length").alias("n_bytes"), F.max("start_byte").alias("last_start"))


_TAUS = (0.45, 1.5, 2.05)


@query("f4_rethreshold", lambda d: " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS tau, doc_id, count(*) AS n_patches, max(patch_length) AS longest FROM ({duck_patches(t)}) GROUP BY doc_id" for t in _TAUS))
def rethreshold(spark, sf):
    """The same scores under several thresholds: the series is made once per row."""
    return segment.summaries(frame(spark, sf, "documents"), _TAUS).select("tau", "doc_id", "n_patches", F.col("max_bpp").alias("longest"))


@query("e12_entropy_statistics", lambda d: f"SELECT doc_id, count(*) AS n_bytes, round(avg(CAST(score AS DOUBLE)), 6) AS ent_mean, round(CAST(max(score) AS DOUBLE), 6) AS ent_max, round(avg(CASE WHEN CAST(score AS DOUBLE) > {TAU!r} THEN 1.0 ELSE 0.0 END), 6) AS frac_above_tau FROM ({duck_scores()}) GROUP BY doc_id")
def entropy_statistics(spark, sf):
    return _rounded(segment.summaries(frame(spark, sf, "documents"), [TAU]).select("doc_id", "n_bytes", "ent_mean", "ent_max", "frac_above_tau"))


@query("hs40_mock_entropy", lambda d: f"SELECT doc_id, count(*) AS n, sum(CAST(round(CAST(score AS DOUBLE) * 1000) AS BIGINT))::BIGINT AS total_milli, count(*) FILTER (WHERE score > 1) AS n_high FROM ({duck_scores()}) GROUP BY doc_id")
def mock_entropy(spark, sf):
    return segment.summaries(frame(spark, sf, "documents"), [TAU]).select("doc_id", F.col("n_bytes").alias("n"), "total_milli", "n_high")


_RUN = f"SELECT doc_id, count(*) AS n_bytes, round(avg(CAST(score AS DOUBLE)), 6) AS ent_mean FROM ({duck_scores()}) GROUP BY doc_id"


@query("e13_run_summary", lambda d: f"SELECT b.doc_id, 'mock' AS run_id, b.n_patches, b.mean_bpp, b.n_init, b.n_entropy, r.n_bytes, r.ent_mean, r.n_bytes // 512 AS n_chunk_edges, greatest(0, r.n_bytes - 511) AS n_truncated FROM ({_bpp(duck_patches())}) b JOIN ({_RUN}) r USING (doc_id)")
def run_summary(spark, sf):
    rows = segment.summaries(frame(spark, sf, "documents"), [TAU])
    out = rows.select("doc_id", F.lit("mock").alias("run_id"), "n_patches", "mean_bpp", "n_init", "n_entropy", "n_bytes", "ent_mean", F.expr("n_bytes div 512").alias("n_chunk_edges"), F.greatest(F.lit(0).cast("long"), F.col("n_bytes") - 511).alias("n_truncated"))
    return _rounded(out)


_EVENTS_TAU = 60.0


@query("f1_event_segments", lambda d: f"""SELECT user_id, count(*) AS n_segments, CAST(max(len) AS BIGINT) AS longest FROM (SELECT user_id, lead(i, 1, n) OVER (PARTITION BY user_id ORDER BY i) - i AS len FROM
  (SELECT user_id, i, value, count(*) OVER (PARTITION BY user_id) AS n FROM {d.t('series')}) WHERE i = 0 OR value > {_EVENTS_TAU}) GROUP BY user_id""")
def event_segments(spark, sf):
    """Threshold segmentation of each user's ordered event values."""
    rows = frame(spark, sf, "series").withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    starts = rows.where((F.col("i") == 0) | (F.col("value") > _EVENTS_TAU))
    length = F.lead("i").over(Window.partitionBy("user_id").orderBy("i"))
    return starts.withColumn("len", F.coalesce(length, F.col("n")) - F.col("i")).groupBy("user_id").agg(F.count("*").alias("n_segments"), F.max("len").cast("long").alias("longest"))


# -- baselines ---------------------------------------------------------------------------------

_DUCK_LINES = """SELECT doc_id, i, line, CAST(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY i) - octet_length(encode(line)) - 1 AS BIGINT) AS start_byte, n FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, octet_length(encode(text)) AS n FROM documents)"""


@query("f17_newline_offsets", lambda d: f"SELECT doc_id, start_byte AS byte_offset FROM ({_DUCK_LINES}) WHERE i > 0 AND start_byte < n")
def newline_offsets(spark, sf):
    return baselines.newlines(frame(spark, sf, "documents"))


_INDENT = f"""SELECT doc_id, start_byte + ind AS byte_offset FROM (SELECT *, lag(ind, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM
  (SELECT *, octet_length(encode(line)) - octet_length(encode(regexp_replace(line, '^[ \\t]+', ''))) AS ind FROM ({_DUCK_LINES}) WHERE regexp_matches(line, '[^ \\t\\r]'))) WHERE ind <> before"""


@query("f16_indentation_change", lambda d: _INDENT)
def indentation_change(spark, sf):
    return baselines.indent_changes(frame(spark, sf, "documents"))


@query("f16_indentation_change_pages", lambda d: _INDENT.replace("doc_id", "page_id").replace("documents", "pages").replace("(text,", "(html,").replace("(text)", "(html)"))
def indentation_change_pages(spark, sf):
    return baselines.indent_changes(frame(spark, sf, "pages"), "page_id", "html")


@query("f18_word_starts", lambda d: f"SELECT doc_id, count(*) AS n, CAST(sum(start_byte) AS BIGINT) AS total, count(*) FILTER (WHERE start_byte > 0) AS n_interior FROM {d.t('words')} GROUP BY doc_id")
def word_starts(spark, sf):
    return frame(spark, sf, "words").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start_byte").alias("total"), F.count_if(F.col("start_byte") > 0).alias("n_interior"))


@query("f19_segment_starts", lambda d: f"SELECT doc_id, off FROM (SELECT doc_id, 0::BIGINT AS off FROM documents WHERE text <> '' UNION SELECT doc_id, start_byte FROM ({_DUCK_LINES}) WHERE i > 0 AND start_byte < n UNION SELECT * FROM ({_INDENT}))")
def segment_starts(spark, sf):
    """Zero and every newline or indentation offset, once each."""
    docs = frame(spark, sf, "documents")
    zero = docs.where("text <> ''").select("doc_id", F.lit(0).cast("long").alias("off"))
    marks = baselines.newlines(docs).unionAll(baselines.indent_changes(docs)).withColumnRenamed("byte_offset", "off")
    return zero.unionAll(marks).distinct()


@shared("f29_tumbling_windows")
def _(d):
    return f"""SELECT doc_id, w * 512 AS start_byte, least(512, n_bytes - w * 512) AS length FROM (SELECT doc_id, n_bytes, {d.series(0, d.int_div('(n_bytes - 1)', 512))} AS w FROM {d.t('manifest')} WHERE n_bytes > 0) q
      WHERE n_bytes - w * 512 >= 16"""


@shared("f30_token_chunks")
def _(d):
    return f"""SELECT doc_id, c AS chunk, c * 8192 AS first_token, least(n_bytes + 1, (c + 1) * 8192) AS end_token FROM (SELECT doc_id, n_bytes, {d.series(0, d.int_div('n_bytes', 8192))} AS c FROM {d.t('manifest')}) q"""


@shared("f27_chunk_context")
def _(d):
    return f"SELECT doc_id, n_bytes, {d.int_div('n_bytes', 512)} AS n_chunk_edges, greatest(0, n_bytes - 511) AS n_bytes_truncated_context FROM {d.t('manifest')}"


@query("f3_v1_reasons", lambda d: f"SELECT reason, count(*) AS n, CAST(sum(end_byte) AS BIGINT) AS total_end FROM (SELECT start_byte + patch_length AS end_byte, CASE coalesce(lead(trigger) OVER (PARTITION BY doc_id ORDER BY patch_index), 'eof') WHEN 'length_cap' THEN 'max_length' ELSE coalesce(lead(trigger) OVER (PARTITION BY doc_id ORDER BY patch_index), 'eof') END AS reason FROM ({duck_patches()})) GROUP BY reason")
def v1_reasons(spark, sf):
    """A patch ends for the reason that the next one starts; the last one ends with the file."""
    nxt = F.lead("trigger").over(Window.partitionBy("doc_id").orderBy("patch_index"))
    rows = frame(spark, sf, "patches").select((F.col("start_byte") + F.col("patch_length")).alias("end_byte"), F.coalesce(nxt, F.lit("eof")).alias("reason"))
    return rows.replace("length_cap", "max_length", "reason").groupBy("reason").agg(F.count("*").alias("n"), F.sum("end_byte").alias("total_end"))


@query("e20_length_histogram", lambda d: f"SELECT lang, bin, round(c * 1.0::DOUBLE / sum(c) OVER (PARTITION BY lang), 9) AS share FROM (SELECT lang, least(patch_length, 40) AS bin, count(*) AS c FROM ({duck_patches()}) JOIN documents USING (doc_id) GROUP BY lang, bin)")
def length_histogram(spark, sf):
    """Texts give their own histograms under their language, so patches neither shuffle nor meet the documents again."""
    docs = frame(spark, sf, "documents").where("doc_id IS NOT NULL")
    binned = segment.length_histograms(docs, TAU, 40, key="lang").groupBy("lang", "bin").agg(F.sum("n").alias("c"))
    return binned.select("lang", "bin", F.round(F.col("c") / F.sum("c").over(Window.partitionBy("lang")), 9).alias("share"))


@query("e21_bpp_quartiles", lambda d: f"SELECT lang, round(quantile_cont(mean_bpp, 0.25), 6) AS q25, round(quantile_cont(mean_bpp, 0.5), 6) AS q50, round(quantile_cont(mean_bpp, 0.75), 6) AS q75, count(*) AS n FROM ({_bpp(duck_patches())}) JOIN documents USING (doc_id) GROUP BY lang")
def bpp_quartiles(spark, sf):
    stats = segment.summaries(frame(spark, sf, "documents"), [TAU]).select("doc_id", F.round("mean_bpp", 6).alias("mean_bpp"))
    rows = stats.join(frame(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    q = [F.round(F.percentile("mean_bpp", p), 6).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return rows.groupBy("lang").agg(*q, F.count("*").alias("n"))


@query("e16_file_means", lambda d: f"SELECT lang, round(avg(mean_bpp), 6) AS mean, round(stddev_samp(mean_bpp), 6) AS sd, round(avg(var_bpp), 6) AS mean_var FROM ({_bpp(duck_patches())}) JOIN documents USING (doc_id) GROUP BY lang")
def file_means(spark, sf):
    rows = bpp_summary(spark, sf).join(frame(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg("mean_bpp"), 6).alias("mean"), F.round(F.stddev_samp("mean_bpp"), 6).alias("sd"), F.round(F.avg("var_bpp"), 6).alias("mean_var"))


@query("e14_diagnostics", lambda d: f"SELECT b.doc_id, lang, n_bytes, n_entropy, round(n_entropy * 1.0::DOUBLE / n_bytes, 9) AS entropy_density, round((n_patches - 1) * 1.0::DOUBLE / n_bytes, 9) AS internal_density, mean_bpp, median_bpp, var_bpp FROM ({_bpp(duck_patches())}) b JOIN documents USING (doc_id)")
def diagnostics(spark, sf):
    rows = bpp_summary(spark, sf).join(frame(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", "lang", "n_bytes", "n_entropy", F.round(F.col("n_entropy") / F.col("n_bytes"), 9).alias("entropy_density"), F.round((F.col("n_patches") - 1) / F.col("n_bytes"), 9).alias("internal_density"), "mean_bpp", "median_bpp", "var_bpp")


# -- bytes, characters, hashes -------------------------------------------------------------------


@query("hs6_char_to_byte", lambda d: "SELECT doc_id, len(c) AS n_chars, CAST(list_sum(list_transform(c, lambda x: octet_length(encode(x)))) AS BIGINT) AS n_bytes, len(list_filter(c, lambda x: octet_length(encode(x)) > 1)) AS n_multi FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents)")
def char_to_byte(spark, sf):
    chars = F.expr("filter(split(text, ''), x -> x <> '')")
    rows = frame(spark, sf, "documents").select("doc_id", chars.alias("c"))
    total = F.expr("aggregate(c, 0L, (a, x) -> a + octet_length(x))")
    return rows.select("doc_id", F.size("c").cast("long").alias("n_chars"), total.alias("n_bytes"), F.expr("CAST(size(filter(c, x -> octet_length(x) > 1)) AS BIGINT)").alias("n_multi"))


_DUCK_CHARS = """SELECT doc_id, c, i, CAST(coalesce(sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte FROM
  (SELECT doc_id, unnest(m) AS c, unnest(range(len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS m FROM documents))"""


@query("hs6_char_to_byte_map", lambda d: f"SELECT doc_id, i AS char_offset, byte AS byte_offset FROM ({_DUCK_CHARS}) WHERE i % 7 = 3")
def char_to_byte_map(spark, sf):
    """The map itself, of which every seventh character is shown."""
    rows = offsets.char_to_byte(frame(spark, sf, "documents").where("text IS NOT NULL"))
    return rows.select("doc_id", F.expr("posexplode(slice(bytes, 1, size(bytes) - 1))").alias("char_offset", "byte_offset")).where("char_offset % 7 = 3").withColumn("char_offset", F.col("char_offset").cast("long"))


@query("hs7_byte_to_char_map", lambda d: f"SELECT doc_id, byte AS byte_offset, i AS char_offset FROM ({_DUCK_CHARS}) WHERE octet_length(encode(c)) > 1")
def byte_to_char_map(spark, sf):
    """Where characters of several bytes start: the byte behind is inside of one."""
    rows = offsets.byte_to_char(frame(spark, sf, "documents").where("text IS NOT NULL"))
    some = F.expr("filter(transform(chars, (x, i) -> struct(CAST(i AS BIGINT) AS byte_offset, x AS char_offset, coalesce(get(chars, i + 1), 0) AS after)), p -> p.char_offset >= 0 AND p.after < 0)")
    return rows.select("doc_id", F.explode(some).alias("p")).select("doc_id", "p.byte_offset", "p.char_offset")


@query("hs8_converted_offsets", lambda d: f"""SELECT t.doc_id, t.off, CASE WHEN t.off > n THEN 'outside' WHEN t.off < n AND m.i IS NULL THEN 'inside_character' END AS problem, CASE WHEN t.off = n THEN k ELSE m.i END AS converted
  FROM (SELECT doc_id, unnest([0, 5, 90, 1000000]) AS off, octet_length(encode(text)) AS n, length(text) AS k FROM documents WHERE text IS NOT NULL) t LEFT JOIN ({_DUCK_CHARS}) m ON m.doc_id = t.doc_id AND m.byte = t.off""")
def converted_offsets(spark, sf):
    """Byte offsets to characters, with what is wrong with those that have none."""
    docs = frame(spark, sf, "documents").where("text IS NOT NULL")
    wanted = docs.select("doc_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 5, 90, 1000000)))).alias("off"))
    return offsets.converted(wanted, offsets.byte_to_char(docs), "doc_id", "off", "chars").select("doc_id", "off", "problem", "converted")


@query("hs9_char_boundary", lambda d: "SELECT doc_id, off, off <= len(h) AND (off = len(h) OR h[off + 1] < '80' OR h[off + 1] >= 'C0') AS at_edge FROM (SELECT doc_id, h, unnest([0, 7, 90, 1000000]) AS off FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE text IS NOT NULL))")
def char_boundary(spark, sf):
    docs = frame(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 7, 90, 1000000)))).alias("off"))
    return docs.select("doc_id", "off", offsets.is_char_boundary("text", "off").alias("at_edge"))


@query("hs13_byte_scores", lambda d: "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id, value, lead(i) OVER (PARTITION BY user_id ORDER BY i) AS later FROM " + d.t("series") + ") WHERE later IS NOT NULL GROUP BY user_id")
def byte_scores(spark, sf):
    """Each user's values as scores of tokens: the last one, about no byte, goes."""
    rows = _value_lists(spark, sf).select("user_id", offsets.byte_scores("v").alias("s")).where("size(s) > 0")
    return rows.select("user_id", F.size("s").cast("long").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _value_lists(spark, sf):
    return frame(spark, sf, "series").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("v"))


@query("hs14_token_patch_starts", lambda d: f"SELECT file_id, CAST(end_byte - 1 AS BIGINT) AS start FROM {d.t('tiles')} WHERE pos < n_patches AND end_byte >= 1 AND end_byte - 1 < n_bytes - 1")
def token_patch_starts(spark, sf):
    """Patch lengths in tokens, the start token among them, as byte starts."""
    rows = frame(spark, sf, "tiles").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "len"))), lambda x: x["len"]).alias("lens"), (F.max("n_bytes") - 1).alias("n"))
    return rows.select("file_id", F.explode(offsets.patch_byte_starts("lens", "n")).alias("start"))


@query("hs15_start_ids", lambda d: f"SELECT user_id, unnest([0, 1]) AS start FROM (SELECT DISTINCT user_id FROM {d.t('series')}) UNION ALL SELECT user_id, i + 1 FROM {d.t('series')} WHERE i >= 1 AND value > 60.0")
def start_ids(spark, sf):
    return _value_lists(spark, sf).select("user_id", F.explode(offsets.start_ids("v", 60.0).cast("array<bigint>")).alias("start"))


@query("hs5_char_start_mask", lambda d: "SELECT doc_id, len(list_filter(h, lambda x: x < '80' OR x >= 'C0')) AS n_starts, len(h) AS n_bytes FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents)")
def char_start_mask(spark, sf):
    docs = frame(spark, sf, "documents")
    return docs.select("doc_id", F.char_length("text").cast("long").alias("n_starts"), B.byte_length(F.col("text")).alias("n_bytes"))


@query("hs12_token_ids", lambda d: "SELECT doc_id, len(h) + 1 AS n_tokens, CAST(coalesce(list_sum(list_transform(h, lambda x: CAST('0x' || x AS BIGINT) + 4)), 0) + 1 AS BIGINT) AS total FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents)")
def token_ids(spark, sf):
    """A start token 1, then every byte plus 4."""
    rows = offsets.token_ids(frame(spark, sf, "documents"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.expr("aggregate(ids, 0L, (a, x) -> a + x)").alias("total"))


@shared("hs1_sha256")
def _(d):
    return f"SELECT doc_id, {d.sha('text')} AS sha256, {d.size('text')} AS n_bytes FROM {d.t('documents')}"


@shared("hs2_keyed_hash_rank")
def _(d):
    return f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {d.key(chr(39) + '20260927' + chr(39), 'lang', 'doc_id')}, doc_id) AS rnk FROM {d.t('documents')}"


@shared("hs3_hex_prefix")
def _(d):
    return f"SELECT doc_id, {d.hash32(d.sha('text'))} AS rnk, {d.hash32(d.sha('source'))} % 20 AS bucket FROM {d.t('documents')}"


@query("hs28_show_patches")
def show_patches(spark, sf):
    """The patches of each document joined by bars; undecodable bytes are replaced."""
    docs = frame(spark, sf, "documents")
    starts = segment.patches(docs, TAU).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_byte", "patch_length"))).alias("p"))
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("b"))
    shown = F.expr("array_join(transform(p, x -> make_valid_utf8(CAST(substring(b, CAST(x.start_byte + 1 AS INT), x.patch_length) AS STRING))), '|')")
    return raw.join(starts, "doc_id").select("doc_id", shown.alias("shown"))


@shared("hs22_heading_level")
def _(d):
    """A level is one '= ' before and one ' =' behind the title; each takes four characters."""
    made = f"SELECT doc_id, idx, CASE idx % 3 WHEN 1 THEN concat(' = ', piece, ' =') WHEN 2 THEN concat('= = ', piece, ' = = ') ELSE piece END AS line FROM {d.t('lines')}"
    bare = d.replace("line", "^[ \\t\\r]+|[ \\t\\r]+$", "")
    level = f"least({d.int_div('length(' + d.extract('s', '^((= )*)', 1) + ')', 2)}, {d.int_div('length(' + d.extract('s', '(( =)*)$', 1) + ')', 2)}, {d.int_div('length(s)', 4)})"
    return f"""SELECT doc_id, idx, CASE WHEN level > 0 THEN CAST(level AS BIGINT) END AS level, CASE WHEN level > 0 THEN trim(substr(s, CAST(2 * level + 1 AS INT), CAST(length(s) - 4 * level AS INT))) END AS title
      FROM (SELECT doc_id, idx, s, {level} AS level FROM (SELECT doc_id, idx, {bare} AS s FROM ({made}) m) x) y"""


@shared("hs20_opener_token")
def _(d):
    return f"""SELECT opener, count(*) AS n FROM (SELECT CASE WHEN {d.extract("piece", "^[A-Za-z_][A-Za-z0-9_]*")} = '' THEN '<non-word>' ELSE {d.extract("piece", "^[A-Za-z_][A-Za-z0-9_]*")} END AS opener FROM {d.t('lines')}) q GROUP BY opener"""


@shared("hs21_first_token_length")
def _(d):
    return f"""SELECT doc_id, start_byte, greatest(1, length({d.extract("piece", "^[A-Za-z0-9_]*")})) AS token_length FROM {d.t('sentences')}"""


@shared("hs23_repository_from_url")
def _(d):
    return f"""SELECT page_id, CASE WHEN {d.matches('url', '^https?://[^/]+/[^/]+')} THEN {d.extract('url', '^https?://([^/]+/[^/]+)', 1)} ELSE url END AS repo FROM {d.t('pages')}"""


@shared("hs17_invert_case")
def _(d):
    """snake_case to camelCase and back; other names have no image."""
    snake = d.replace("piece", "([A-Z])", "_$1" if d.spark else "_\\1")
    parts = "transform(slice(split(piece, '_'), 2, 1000000), x -> concat(upper(substr(x, 1, 1)), substr(x, 2)))" if d.spark else "list_transform(string_split(piece, '_')[2:], lambda x: upper(substr(x, 1, 1)) || substr(x, 2))"
    head = "split(piece, '_')[0]" if d.spark else "string_split(piece, '_')[1]"
    camel = f"concat({head}, {'array_join' if d.spark else 'array_to_string'}({parts}, ''))"
    made = f"SELECT CASE idx % 3 WHEN 1 THEN concat('a1_', lower(piece), '_b') WHEN 2 THEN concat('ab', piece) ELSE piece END AS piece FROM {d.t('words')}"
    return f"""SELECT piece, CASE WHEN {d.matches('piece', '^[a-z][a-z0-9]*(_[a-z0-9]+)+$')} THEN {camel} WHEN {d.matches('piece', '^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$')} THEN lower({snake}) END AS inverted, n
      FROM (SELECT piece, count(*) AS n FROM ({made}) m GROUP BY piece) q"""


@shared("hs27_normalised_lines")
def _(d):
    space = "[ \\\\t\\\\r\\\\n]+"
    return f"""SELECT doc_id, substr(trim({d.replace('text', space, ' ')}), 1, 240) AS shown FROM {d.t('documents')}"""


@shared("hs29_distribution_entropy")
def _(d):
    return f"""SELECT lang, round(-sum(p * ln(p)), 9) AS nats, round(-sum(p * ln(p)) / ln(2), 9) AS bits FROM (SELECT lang, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY lang) AS p FROM
      (SELECT lang, source, count(*) AS c FROM {d.t('documents')} GROUP BY lang, source) a) b GROUP BY lang"""


_DUCK_TOKEN = lexer.PATTERN.replace("'", "''")


@query("hs24_lexer", lambda d: f"""SELECT kind, count(*) AS n, CAST(sum(length(tok)) AS BIGINT) AS n_chars FROM (SELECT tok, CASE WHEN regexp_matches(tok, '^(//|/[*])') THEN 'comment' WHEN regexp_matches(tok, '^["'']') THEN 'string' WHEN regexp_matches(tok, '^[A-Za-z_]') THEN 'name'
  WHEN regexp_matches(tok, '^[.]?[0-9]') THEN 'number' ELSE 'operator' END AS kind FROM (SELECT unnest(regexp_extract_all(html, '{_DUCK_TOKEN}')) AS tok FROM pages)) WHERE kind <> 'comment' GROUP BY kind""")
def lexed(spark, sf):
    """Tokens of C-like text by ordered alternatives; blanks and comments are dropped."""
    tok = frame(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(lexer.PATTERN), F.lit(0))).alias("tok"))
    kind = F.when(F.col("tok").rlike("^(//|/[*])"), "comment").when(F.col("tok").rlike("^[\"']"), "string").when(F.col("tok").rlike("^[A-Za-z_]"), "name").when(F.col("tok").rlike("^[.]?[0-9]"), "number").otherwise("operator")
    return tok.select(kind.alias("kind"), "tok").where("kind <> 'comment'").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("tok")).alias("n_chars"))


@query("hs25_text_labels")
def text_labels(spark, sf):
    return lexer.text_labels(frame(spark, sf, "pages"), "page_id", "html").groupBy("label").agg(F.count("*").alias("n"))


@query("f22_tag_depth", lambda d: """SELECT page_id, max(depth)::BIGINT AS deepest, count(*) AS n_tags FROM (SELECT page_id, sum(CASE WHEN regexp_matches(tag, '^</') THEN -1 WHEN regexp_matches(tag, '/>$') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM
  (SELECT page_id, unnest(m) AS tag, unnest(range(len(m))) AS i FROM (SELECT page_id, regexp_extract_all(html, '</?[a-z][a-z0-9]*[^>]*>') AS m FROM pages))) GROUP BY page_id""")
def tag_depth(spark, sf):
    """Depth-first order is the order of tags; the depth is a running sum of openings less closings."""
    tags = frame(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("</?[a-z][a-z0-9]*[^>]*>"), F.lit(0))).alias("i", "tag"))
    step = F.when(F.col("tag").rlike("^</"), -1).when(F.col("tag").rlike("/>$"), 0).otherwise(1)
    depth = F.sum(step).over(Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return tags.select("page_id", depth.alias("depth")).groupBy("page_id").agg(F.max("depth").alias("deepest"), F.count("*").alias("n_tags"))


@shared("f20_title_carry")
def _(d):
    return f"""SELECT conv_id, turn, {"last(sys, true)" if d.spark else "last_value(sys IGNORE NULLS)"} OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM
      (SELECT conv_id, turn, CASE WHEN role = 'system' OR role = 'user' THEN concat(role, '-', turn) END AS sys FROM {d.t('conversations')}) q"""


@shared("f21_latest_status")
def _(d):
    return f"""SELECT user_id, {d.max_by('event_type', 'i')} AS status, CAST(max(i) AS BIGINT) AS last_i, count(*) AS attempts FROM {d.t('series')} GROUP BY user_id"""


@shared("e22_grid_layout")
def _(d):
    return f"""SELECT doc_id, idx AS line, {d.int_div('end_byte - start_byte', 100)} + 1 AS n_rows, (end_byte - start_byte) % 100 AS last_col FROM {d.t('lines')}"""


@shared("f28_moving_context")
def _(d):
    return f"""SELECT user_id, i, count(*) OVER w AS seen, round(coalesce(sum(value) OVER w, 0), 4) AS total FROM {d.t('series')}
      WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)"""
