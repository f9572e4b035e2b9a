"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document is measured by itself; the failures of each rule are then counted by host, the
hosts' rates are shrunk towards the corpus by a beta prior fitted to all hosts, and a host whose
shrunken rate passes the limit makes its documents that fail that rule be rejected. A document
that fails no rule is always kept, whatever its host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import Workspace, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Shrunken share of failing documents from which a host counts as bad for a rule.
HOST_LIMIT = 0.4

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# rule -> SQL over the measures
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeat": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
BASE = ("short", "repeat")

# transform(array(x), y -> ...)[0] evaluates x once however often y stands in the body
_REPEATED = """
transform(array(filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')), w -> struct(
  size(w) AS n_words,
  IF(size(w) < 4, 0,
    transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))), g ->
      IF(size(g) = size(array_distinct(g)), 0,
        transform(array(sort_array(transform(g, (h, i) -> struct(h AS h, i AS i)))), s ->
          size(array_distinct(flatten(transform(
            filter(s, (e, k) -> coalesce(get(s, k - 1).h = e.h, false) OR coalesce(get(s, k + 1).h = e.h, false)),
            e -> array(e.i, e.i + 1, e.i + 2))))))[0]))[0]) AS n_repeat_words))[0]
"""
_LINES = """
transform(array(filter(split(t, '\\\\n'), x -> length(translate(x, ' \\t\\u000b\\u000c\\r', '')) > 0)), l ->
  struct(size(l) AS n, size(l) - size(array_distinct(l)) AS dup))[0]
"""

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measures(text: str = "text"):
    """One struct of MEASURES (long) of the whole text; null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    one = F.transform(
        F.array(t),
        lambda t: F.struct(
            F.expr(_REPEATED.replace("(t,", f"(coalesce(`{text}`, ''),")).alias("w"),
            F.expr(_LINES.replace("(t,", f"(coalesce(`{text}`, ''),")).alias("l"),
            F.length(F.translate(t, SPACES, "")).alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        ),
    )[0]
    return F.transform(
        F.array(one),
        lambda m: F.struct(*(
            c.cast("long").alias(n)
            for n, c in (("n_words", m["w"]["n_words"]), ("word_chars", m["word_chars"]), ("n_symbols", m["n_symbols"]), ("n_dup_lines", m["l"]["dup"]), ("n_repeat_words", m["w"]["n_repeat_words"]), ("n_lines", m["l"]["n"]))
        )),
    )[0]


def host_verdicts(measured: DataFrame, work: Workspace, *, host: str = "host", limit: float = HOST_LIMIT) -> DataFrame:
    """host, bad_<rule> for every host (null is a host of its own), from rows with host and MEASURES.

    The prior of a rule has the corpus rate m as its mean; its strength s fits the variance v of
    the hosts' rates, s = m (1 - m) / v - 1, held to 1..1e6. A rate is (failures + m s) / (n + s).
    """
    fails = [F.count_if(F.expr(r)).alias(f"f_{k}") for k, r in RULES.items()]
    hosts = work.keep(measured.groupBy(host).agg(F.count("*").alias("n"), *fails))
    of = hosts.agg(
        *(F.expr(f"sum(f_{k}) / greatest(sum(n), 1)").alias(f"m_{k}") for k in RULES),
        *(F.expr(f"coalesce(var_pop(f_{k} / n), 0)").alias(f"v_{k}") for k in RULES),
    ).first()
    bad = []
    for k in RULES:
        m, v = of[f"m_{k}"] or 0.0, of[f"v_{k}"]
        s = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
        bad.append(((F.col(f"f_{k}") + F.lit(m * s)) / (F.col("n") + F.lit(s)) > limit).alias(f"bad_{k}"))
    return hosts.select(F.col(host).alias("verdict_host"), *bad)


def _judged(rows: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """rows with base_failed and kept; verdicts has a row for every host."""
    joined = rows.join(verdicts, rows[host].eqNullSafe(verdicts["verdict_host"]), "left")
    base = " OR ".join(f"({RULES[k]})" for k in BASE)
    by_host = " OR ".join(f"(coalesce(bad_{k}, false) AND ({r}))" for k, r in RULES.items())
    return joined.withColumn("base_failed", F.expr(base)).withColumn("kept", F.expr(f"NOT (({base}) OR {by_host})"))


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host, MEASURES, base_failed and kept for every row of ``docs``.

    Null text fails as too short; null keys and repeated rows are judged each; a null host is a
    host; other columns are left out, so their names can't clash. No documents: no rows.
    """
    work = Workspace(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), measures(text).alias("q"))
    rows = work.keep(rows.select("key", "host", "q.*"))
    return _judged(rows, host_verdicts(rows, work), "host").select(F.col("key").alias(key), *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, *, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with all their columns.

    Null text goes, as too short; null keys and repeated rows are judged each; a null host is a host;
    no documents: no rows. Texts are measured once and written with their measures; only rows that
    fail a host's rule, and no base rule, meet the hosts.
    """
    work = Workspace(docs.sparkSession)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(host).alias("host"), measures(text).alias("q"))
    rows = work.keep(whole.select("doc", "host", "q.*"))
    verdicts = host_verdicts(rows, work)
    base, other = (" OR ".join(f"({r})" for k, r in RULES.items() if (k in BASE) == of) for of in (True, False))
    clear = rows.where(f"NOT ({base}) AND NOT ({other})").select("doc.*")
    doubtful = _judged(rows.where(f"NOT ({base}) AND ({other})"), verdicts, "host").where("kept").select("doc.*")
    return clear.unionAll(doubtful)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    space = "[\\x20\\x09-\\x0D]+"
    fails = ", ".join(f"count(*) FILTER (WHERE {r}) AS f_{k}" for k, r in RULES.items())
    prior = ", ".join(f"sum(f_{k}) / sum(n) AS m_{k}, coalesce(var_pop(f_{k} / n), 0) AS v_{k}" for k in RULES)
    strength = ", ".join(f"CASE WHEN v_{k} > 0 THEN least(greatest(m_{k} * (1 - m_{k}) / v_{k} - 1, 1.0), 1e6) ELSE 1e6 END AS s_{k}" for k in RULES)
    bad = ", ".join(f"(f_{k} + m_{k} * s_{k}) / (n + s_{k}) > {HOST_LIMIT} AS bad_{k}" for k in RULES)
    base = " OR ".join(f"({RULES[k]})" for k in BASE)
    by_host = " OR ".join(f"(bad_{k} AND ({r}))" for k, r in RULES.items())
    return f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '{space}'), lambda x: x <> '') AS w,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
q AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
h AS (SELECT host, count(*) AS n, {fails} FROM q GROUP BY host),
p AS (SELECT *, {strength} FROM (SELECT {prior} FROM h)),
b AS (SELECT host, {bad} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT (({base}) OR {by_host}) AS kept
FROM q JOIN b ON q.host IS NOT DISTINCT FROM b.host
"""


ORACLE = _oracle()
