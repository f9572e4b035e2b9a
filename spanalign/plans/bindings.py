"""Relations that bind the driver's tables to documents, patches, spans and runs.

documents are byte strings; words, lines and sentences of their text are nested spans. lineitem is a
set of files (orders) that are tiled by patches (lines) of l_quantity bytes, with spans beside them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.functions.bytesops import HIGH, LOW, MODULUS, SEPARATORS, STEP, pieces
from spanalign.operators.resample import drawn, permuted_ends, replicate_sums, resampled
from spanalign.operators.segment import patches
from spanalign.plans.registry import frame, run_sql

#: Exactly a float32, as scores are.
TAU = 1.3354420661926270
WORD, LINE, SENTENCE = "[A-Za-z0-9_]+", r"[^\n]+", r"[^\n.]+[.]?"
SEP_HEX = ", ".join(f"'{ord(c):02X}'" for c in SEPARATORS)


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def duck_pieces(pattern: str) -> str:
    """DuckDB: doc_id, idx, start_byte, end_byte, piece of every match in documents."""
    return f"""SELECT doc_id, idx, CAST(e - octet_length(encode(piece)) AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte, piece FROM (
      SELECT doc_id, idx, piece, sum(octet_length(encode(gap)) + coalesce(octet_length(encode(piece)), 0)) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM (
        SELECT doc_id, unnest(m) AS piece, unnest(g) AS gap, unnest(range(len(g))) AS idx FROM (
          SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents))) WHERE piece IS NOT NULL"""


def duck_scores() -> str:
    """DuckDB: doc_id, i, n, score of every byte."""
    return f"""SELECT doc_id, i, n, (CASE WHEN i = 0 OR h[i] IN ({SEP_HEX}) THEN CAST({HIGH} AS FLOAT) ELSE CAST({LOW} AS FLOAT) END
        + CAST(((i * {STEP}) % {MODULUS}) / 1000.0::DOUBLE AS FLOAT)) AS score FROM (
      SELECT doc_id, h, len(h) AS n, unnest(range(len(h))) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents))"""


def duck_patches(tau: float = TAU) -> str:
    return f"""SELECT doc_id, CAST(row_number() OVER w - 1 AS INT) AS patch_index, CAST(i AS BIGINT) AS start_byte,
      CAST(coalesce(lead(i) OVER w, n) - i AS INT) AS patch_length, CASE WHEN i = 0 THEN 'init' ELSE 'entropy' END AS trigger, score
      FROM ({duck_scores()}) WHERE i = 0 OR CAST(score AS DOUBLE) > {tau!r} WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def _tiles(d):
    order = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
    return f"""SELECT file_id, language, pos, len, CASE WHEN pos = n_patches THEN 'eof' WHEN flag = 'A' THEN 'max_length' ELSE 'entropy' END AS reason,
      end_byte - len AS start_byte, end_byte, n_bytes, n_patches, partkey, suppkey, flag, status, line, shipdate FROM (
      SELECT l_orderkey AS file_id, o_orderstatus AS language, l_returnflag AS flag, l_linestatus AS status, l_partkey AS partkey, l_suppkey AS suppkey,
        CAST(l_linenumber AS BIGINT) AS line, l_shipdate AS shipdate, CAST(l_quantity AS BIGINT) AS len,
        CAST(row_number() OVER (PARTITION BY l_orderkey {order}) AS BIGINT) AS pos, CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n_patches,
        CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_byte,
        CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n_bytes
      FROM {d.t('lineitem')} JOIN {d.t('orders')} ON l_orderkey = o_orderkey)"""


def _nodes(d):
    return f"""SELECT file_id, language, n_bytes, concat('n-', pos) AS node_id, CASE WHEN flag = 'N' AND status = 'F' THEN 'module' ELSE concat(flag, status) END AS node_type,
      CASE WHEN line % 2 = 0 THEN 'block' ELSE 'module' END AS parent_type, line % 4 AS depth, s AS start_byte, least(n_bytes, s + suppkey % 20) AS end_byte
      FROM (SELECT *, (partkey * 7 + suppkey) % (n_bytes + 1) AS s FROM {d.t('tiles')}) q"""


def _targets(d, edge):
    return f"""SELECT file_id, language, node_type, depth, {edge} AS off FROM (
      SELECT *, row_number() OVER (PARTITION BY file_id, {edge} ORDER BY depth, start_byte - end_byte, node_type, node_id) AS r
      FROM {d.t('nodes')} WHERE depth > 0 AND node_type <> 'module' AND end_byte > start_byte AND {edge} > 0 AND {edge} < n_bytes) q WHERE r = 1"""


def _predictions(d):
    return f"SELECT DISTINCT file_id, language, end_byte AS off FROM {d.t('tiles')} WHERE reason = 'entropy' AND end_byte > 0 AND end_byte < n_bytes"


def _files(d):
    return f"SELECT file_id, min(language) AS language, min(n_bytes) AS n_bytes, min(n_patches) AS n_patches FROM {d.t('tiles')} GROUP BY file_id"


def _per_file(d):
    """k = 0 counts of start targets by file."""
    return f"""SELECT f.file_id, f.language, CAST(coalesce(m.tp, 0) AS BIGINT) AS tp, CAST(coalesce(p.n, 0) - coalesce(m.tp, 0) AS BIGINT) AS fp, CAST(coalesce(t.n, 0) - coalesce(m.tp, 0) AS BIGINT) AS fn
      FROM {d.t('files')} f
      LEFT JOIN (SELECT file_id, count(*) AS n FROM {d.t('predictions')} GROUP BY file_id) p ON f.file_id = p.file_id
      LEFT JOIN (SELECT file_id, count(*) AS n FROM {d.t('starts')} GROUP BY file_id) t ON f.file_id = t.file_id
      LEFT JOIN (SELECT a.file_id, count(*) AS tp FROM {d.t('predictions')} a JOIN {d.t('starts')} b ON a.file_id = b.file_id AND a.off = b.off GROUP BY a.file_id) m ON f.file_id = m.file_id"""


def _null_ends(d, reps=10, seed=20260927):
    return f"""SELECT file_id, language, rep, pos, reason, n_bytes, CAST(sum(len) OVER (PARTITION BY file_id, rep ORDER BY pos = n_patches, h, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS off
      FROM (SELECT t.*, r.rep, {d.key(f"'{seed}'", 't.file_id', 'r.rep', 't.pos')} AS h FROM {d.t('tiles')} t CROSS JOIN (SELECT {d.series(0, reps - 1)} AS rep) r) q"""


def _null_counts(d):
    """tp of each replicate by file, k = 0, start targets; every file has a row for each replicate."""
    return f"""SELECT n.file_id, n.language, n.rep, CAST(count(b.off) AS BIGINT) AS tp FROM
        (SELECT file_id, language, rep, CASE WHEN reason = 'entropy' AND off < n_bytes THEN off END AS off FROM {d.t('null_ends')}) n
      LEFT JOIN {d.t('starts')} b ON n.file_id = b.file_id AND n.off = b.off GROUP BY n.file_id, n.language, n.rep"""


def _boot(d, reps=20, seed=7):
    """rep, file_id, weight: draws with replacement, as many as files."""
    return f"""SELECT rep, f.file_id, CAST(count(*) AS BIGINT) AS weight FROM (
        SELECT rep, {d.hash32(d.key(f"'{seed}'", 'rep', 'j'))} % n AS number FROM (SELECT rep, n, {d.series(0, 'n - 1')} AS j FROM
          (SELECT count(*) AS n FROM {d.t('files')}) c CROSS JOIN (SELECT {d.series(0, reps - 1)} AS rep) r) x) w
      JOIN (SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS number FROM {d.t('files')}) f ON w.number = f.number GROUP BY rep, f.file_id"""


def _swaps(d, reps=20):
    """rep, diff: the sum of the files' differences, each with its sign swapped by a fair coin."""
    h = d.key("'5'", "r.rep", "p.file_id")
    return f"""SELECT r.rep, CAST(sum(CASE WHEN substr({h}, 1, 1) < '8' THEN p.fn - p.tp ELSE p.tp - p.fn END) AS BIGINT) AS diff FROM {d.t('per_file')} p CROSS JOIN (SELECT {d.series(0, reps - 1)} AS rep) r GROUP BY r.rep"""


def _manifest(d):
    """One row per document: id, language, group, size, hash, split."""
    h = d.sha("coalesce(text, '')")
    return f"""SELECT doc_id, lang AS language, source AS grp, {d.size('text')} AS n_bytes, {h} AS sha256, concat(lang, '_', substr({h}, 1, 12)) AS file_id,
      CASE WHEN {d.hash32(d.sha('source'))} % 20 = 0 THEN 'val' ELSE 'train' END AS split, text FROM {d.t('documents')}"""


def _ordered_events(d):
    return f"SELECT event_id, user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM {d.t('events')}"


def _words(d):
    return duck_pieces(WORD)


SQL = {
    "tiles": _tiles,
    "nodes": _nodes,
    "starts": lambda d: _targets(d, "start_byte"),
    "ends": lambda d: _targets(d, "end_byte"),
    "predictions": _predictions,
    "files": _files,
    "per_file": _per_file,
    "null_ends": _null_ends,
    "null_counts": _null_counts,
    "boot": _boot,
    "boot_other": lambda d: _boot(d, seed=8),
    "swaps": lambda d: _swaps(d),
    "manifest": _manifest,
    "series": _ordered_events,
    "words": _words,
    "lines": lambda d: duck_pieces(LINE),
    "sentences": lambda d: duck_pieces(SENTENCE),
    "patches": lambda d: duck_patches(),
    "spans": lambda d: f"""SELECT doc_id, 'line' AS node_type, 'document' AS parent_type, 1 AS depth, start_byte, end_byte FROM {d.t('lines')}
        UNION ALL SELECT doc_id, 'sentence', 'line', 2, start_byte, end_byte FROM {d.t('sentences')}
        UNION ALL SELECT doc_id, CASE WHEN {d.matches('piece', '^[0-9]+$')} THEN 'number' WHEN {d.matches('piece', '^[A-Z]')} THEN 'capital' ELSE 'word' END, 'sentence', 3, start_byte, end_byte FROM {d.t('words')}""",
}


def _files_of(spark, sf_dir):
    """Files are the orders that have lines."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("file_id")).distinct()


#: One row per file with its patches by place and its start targets.
_FILE_ARRAYS = """SELECT t.file_id, language, n_bytes, transform(x, p -> p.pos) AS pos, transform(x, p -> p.len) AS len, transform(x, p -> p.entropy) AS entropy, coalesce(starts, array()) AS starts FROM
      (SELECT file_id, min(language) AS language, min(n_bytes) AS n_bytes, sort_array(collect_list(struct(pos, len, reason = 'entropy' AS entropy))) AS x FROM {tiles} GROUP BY file_id) t
      LEFT JOIN (SELECT file_id, collect_list(off) AS starts FROM {starts} GROUP BY file_id) s ON t.file_id = s.file_id"""

#: Bindings that Spark builds with operators rather than from the text above.
FRAMES = {
    "words": lambda spark, sf: pieces(_docs(spark, sf), WORD),
    "lines": lambda spark, sf: pieces(_docs(spark, sf), LINE),
    "sentences": lambda spark, sf: pieces(_docs(spark, sf), SENTENCE),
    "patches": lambda spark, sf: patches(_docs(spark, sf), TAU),
    "boot": lambda spark, sf: drawn(_files_of(spark, sf), 20, 7, "file_id"),
    "boot_other": lambda spark, sf: drawn(_files_of(spark, sf), 20, 8, "file_id"),
    "file_arrays": lambda spark, sf: run_sql(spark, sf, _FILE_ARRAYS),
    "null_ends": lambda spark, sf: permuted_ends(frame(spark, sf, "tiles"), 10, 20260927, carried=("language", "n_bytes")),
    "null_counts": lambda spark, sf: replicate_sums(frame(spark, sf, "file_arrays"), 10, 20260927, "each"),
}
#: Bindings that a query writes once and reads back, since it reads them more than once.
KEPT: set[str] = set()


def summed_draws(name: str, rows, seed: int, by: list[str], values: list[str], reps=lambda: 20, keyed=lambda: None, once: bool = False) -> None:
    """Binds ``name`` to rep, by and the sums of values over resamples of the files; rows is SQL with one row a file."""
    FRAMES[name] = lambda spark, sf: resampled(run_sql(spark, sf, rows), _files_of(spark, sf), reps(), seed, "file_id", by, values, keyed(), once)
