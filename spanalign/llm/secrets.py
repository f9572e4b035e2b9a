"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Every whole text is scanned for the base kinds and for generic key-like tokens. The values' hashes
are then counted over the corpus by distinct owners and distinct repositories: a value that many
owners have, or many repositories of one owner, is a copied example; one that stays with its owner and
in few repositories looks live. Base spans are all kept;
live-looking generic tokens outside of them are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanalign.llm.common import Workspace, table

#: A value with more distinct owners than this is a widely copied example.
MAX_OWNERS = 1
#: And one with more distinct repositories than this, whoever owns them.
MAX_REPOS = 10

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# kind -> pattern, group of the value, least length of the value
KINDS = {
    "assign": (ASSIGN, 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "live": (r"[A-Za-z0-9_+/-]{20,}", 0, 20),
}
ORDER = list(KINDS)
#: Matches of one text whose places are summed together.
CHUNK = 128
#: Parts into which the places of one value are dealt.
SALT = 64
SPAN = "struct<k:int,s:int,e:int,h:bigint>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: str) -> str:
    """SQL over t: array of SPAN of one kind, leftmost matches from left to right.

    What lies between the matches and the matches themselves alternate, so that running sums of
    their lengths in code points are the places. The value's hash goes with each span.
    """
    pattern, group, least = KINDS[kind]
    p = _quoted(pattern)
    looks = "" if kind != "live" else " AND x.v RLIKE '[0-9]' AND x.v RLIKE '[A-Z]' AND x.v RLIKE '[a-z]'"
    none = f"CAST(array() AS array<{SPAN}>)"
    parts = f"""zip_with(zip_with(split(t, {p}), regexp_extract_all(t, {p}, 0), (a, m) -> struct(a AS a, m AS m)),
      regexp_extract_all(t, {p}, {group}), (x, v) -> struct(length(x.a) AS a, length(x.m) AS m, v AS v))"""
    # an array that grows is copied each time: places are summed by chunks of matches, and from chunk to chunk
    chunks = f"transform(array({parts}), z -> transform(sequence(0, (size(z) - 1) div {CHUNK}), c -> slice(z, c * {CHUNK} + 1, {CHUNK})))[0]"
    begins = "aggregate(y, struct(0 AS at, CAST(array() AS array<int>) AS out), (acc, c) -> struct(aggregate(c, acc.at, (s, x) -> s + x.a + coalesce(x.m, 0)) AS at, array_append(acc.out, acc.at) AS out), acc -> acc.out)"
    inner = f"""aggregate(c, struct(o AS at, {none} AS out),
      (acc, x) -> struct(acc.at + x.a + coalesce(x.m, 0) AS at, IF(x.m IS NULL OR length(x.v) < {least}{_not(looks)}, acc.out,
        array_append(acc.out, struct({ORDER.index(kind)} AS k, acc.at + x.a AS s, acc.at + x.a + x.m AS e, xxhash64(x.v) AS h))) AS out),
      acc -> acc.out)"""
    return f"IF(t RLIKE {p}, transform(array({chunks}), y -> flatten(zip_with(y, {begins}, (c, o) -> {inner})))[0], {none})"


def _not(looks: str) -> str:
    return f" OR NOT ({looks.removeprefix(' AND ')})" if looks else ""


def _shown(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in ORDER)
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({kinds}), x.k + 1), x.s, x.e)), ',')"


def find(rows: DataFrame, text: str) -> DataFrame:
    """rows with base and other, arrays of SPAN of the whole text; null text has none."""
    out = rows.withColumn("t", F.coalesce(F.col(text), F.lit("")))
    return out.withColumns({
        "base": F.expr(f"concat({', '.join(_spans(k) for k in ORDER[:3])})"),
        "other": F.expr(_spans("live")),
    }).drop("t")


def owners(candidates: DataFrame) -> DataFrame:
    """h, n_owners, n_repos from rows (h, owner, repo), each step summed before it is dealt by key.
    A repository belongs to its owner: under two owners it counts as two."""
    single = candidates.groupBy("h", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = single.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, carry=()) -> DataFrame:
    """For each row of docs: key, ``carry`` columns, base and spans (arrays of SPAN by start, then
    kind), n_live and n_copied (base values that stay with at most ``max_owners`` owners and
    in at most ``max_repos`` repositories, or not).

    Null text has no spans; a null owner or repository counts as one of its own; repeated rows are
    scanned each and count as one repository. No documents: no rows.
    """
    work = Workspace(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(repo).alias("repo"), *(F.col(c).alias(f"carry_{c}") for c in carry), F.col(text).alias("scanned"))
    found = work.keep(find(rows, "scanned").drop("scanned").withColumn("row", F.monotonically_increasing_id()))
    each = found.where(F.size("base") + F.size("other") > 0)
    values = each.select("row", "owner", "repo", F.explode(F.concat("base", "other")).alias("x")).select("row", "owner", "repo", "x", F.col("x.h").alias("h"))
    values = values.withColumn("salt", F.pmod("row", F.lit(SALT)))
    held = owners(values.select("h", "owner", "repo")).select("h", ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live"))
    # a value that a third of all texts hold meets its verdict in SALT parts
    salts = values.groupBy("h", "salt").agg(F.lit(1).alias("one")).groupBy("h").agg(F.collect_list("salt").alias("salts"))
    held = held.join(salts, "h").select("h", "live", F.explode("salts").alias("salt"))
    judged = values.join(held, ["h", "salt"]).select("row", "x", "live", (F.col("x.k") < 3).alias("is_base"))
    # a generic token is clear of base spans if none ends behind its start, or starts before its end
    ahead = Window.partitionBy("row").orderBy("x.s", "x.k").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("x.s"), F.desc("x.k")).rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("ended", F.max(F.when(F.col("is_base"), F.col("x.e"))).over(ahead)).withColumn("begun", F.min(F.when(F.col("is_base"), F.col("x.s"))).over(behind))
    clear = ~F.col("is_base") & F.col("live") & (F.coalesce("ended", F.lit(0)) <= F.col("x.s")) & F.coalesce(F.col("begun") >= F.col("x.e"), F.lit(True))
    of_row = judged.groupBy("row").agg(
        F.collect_list(F.when(clear, F.col("x"))).alias("added"),
        F.count_if(F.col("live") & F.col("is_base")).alias("n_live"),
        F.count_if(~F.col("live") & F.col("is_base")).alias("n_copied"),
    )
    order = "(a, b) -> CASE WHEN a.s < b.s THEN -1 WHEN a.s > b.s THEN 1 WHEN a.k < b.k THEN -1 WHEN a.k > b.k THEN 1 ELSE 0 END"
    joined = found.join(of_row, "row", "left").withColumn("base", F.expr(f"array_sort(base, {order})"))
    added = f"coalesce(added, CAST(array() AS array<{SPAN}>))"
    return joined.select(
        F.col("key").alias(key), *(F.col(f"carry_{c}").alias(c) for c in carry), "base",
        F.expr(f"array_sort(concat(base, {added}), {order})").alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


MASK = "[SECRET]"


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """docs with the characters of every span replaced by MASK, one for each run of overlapping
    spans, and n_chars (if there) to match. Rows without spans and null texts stay as they are.
    """
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("txt"), F.col(owner).alias("o"), F.col(repo).alias("r"), F.xxhash64(text).alias("th"))
    found = scan(narrow, key="k", text="txt", owner="o", repo="r", max_owners=max_owners, max_repos=max_repos, carry=("th",)).where(F.size("spans") > 0)
    # what a text's spans are depends on the text alone, so repeated rows share them
    found = found.groupBy("k", "th").agg(F.first("spans").alias("spans"))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("dk"), F.xxhash64(text).alias("dh"), F.col(text).alias("txt"))
    out = whole.join(found.hint("merge"), F.col("dk").eqNullSafe(F.col("k")) & (F.col("dh") == F.col("th")), "left")
    masked = F.expr(f"""aggregate(spans, struct(0 AS at, '' AS out),
      (a, x) -> IF(x.e <= a.at, a, struct(x.e AS at, IF(x.s < a.at, a.out, concat(a.out, substring(txt, a.at + 1, x.s - a.at), '{MASK}')) AS out)),
      a -> concat(a.out, substring(txt, a.at + 1)))""")
    hit = F.col("spans").isNotNull()
    out = out.withColumn("txt", F.when(hit, masked).otherwise(F.col("txt")))
    columns = []
    for c in docs.columns:
        kept = F.col("doc").getField(c)
        if c == text:
            kept = F.col("txt")
        elif c == "n_chars":
            kept = F.when(hit, F.length("txt").cast(docs.schema[c].dataType)).otherwise(kept)
        columns.append(kept.alias(c))
    return out.select(columns)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.k = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(ORDER[:3])]
    return out.select("doc_id", *counts, F.sha2(F.expr(_shown("base")), 256).alias("base_sha256"), F.expr(_shown("spans")).alias("spans"), "n_live", "n_copied")


def _oracle() -> str:
    parts = []
    for i, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        p = "'" + pattern.replace("'", "''") + "'"
        looks = " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')" if kind == "live" else ""
        parts.append(f"""
SELECT doc_id, source, {i} AS k, s, s + m AS e, v FROM (
  SELECT doc_id, source, v, m, sum(a) OVER (PARTITION BY doc_id ORDER BY i) + sum(m) OVER (PARTITION BY doc_id ORDER BY i) - m AS s FROM (
    SELECT doc_id, source, i, v[i] AS v, length(a[i]) AS a, length(m[i]) AS m FROM (
      SELECT doc_id, source, string_split_regex(t, {p}) AS a, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v,
             unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS i FROM d)))
WHERE length(v) >= {least}{looks}""")
    kinds = "[" + ", ".join(f"'{k}'" for k in ORDER) + "]"
    show = f"coalesce(string_agg({kinds}[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k){{}}, '')"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(parts)}),
o AS (SELECT v, count(DISTINCT source) <= {MAX_OWNERS} AS live FROM x GROUP BY v),
y AS (SELECT x.*, o.live FROM x JOIN o USING (v)),
z AS (SELECT * FROM y WHERE k < 3 OR live AND NOT EXISTS (SELECT 1 FROM y b WHERE b.doc_id = y.doc_id AND b.k < 3 AND b.s < y.e AND y.s < b.e))
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256({show.format(" FILTER (WHERE k < 3)")}) AS base_sha256, {show.format("")} AS spans,
  count(*) FILTER (WHERE k < 3 AND live) AS n_live, count(*) FILTER (WHERE k < 3 AND NOT live) AS n_copied
FROM d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id
"""


ORACLE = _oracle()
