"""Named queries with their DuckDB equivalents.

``shared`` queries are written once, over a Dialect that spells the few things the two engines say
differently; ``query`` registers a DataFrame function and, where SQL can express it, its SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from spanalign.sources.writers import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: What writes the SQL of a shared query, over a Dialect.
MAKES: dict[str, Callable] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Dialect:
    """What Spark SQL and DuckDB spell differently. ``t`` names a binding or a table."""

    spark = True
    nul = "chr(0)"

    def t(self, name):
        return "{" + name + "}"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def key(self, *parts):
        return self.sha(f"concat_ws(chr(0), {', '.join(f'CAST({p} AS STRING)' if self.spark else p for p in parts)})")

    def hash32(self, x):
        return f"CAST(conv(substr({x}, 1, 8), 16, 10) AS BIGINT)"

    def hash60(self, x):
        return f"CAST(conv(substr({x}, 1, 15), 16, 10) AS BIGINT)"

    def size(self, x):
        return f"CAST(octet_length({x}) AS BIGINT)"

    def pct(self, x, q):
        return f"percentile({x}, {q})"

    def series(self, a, b):
        return f"explode(sequence({a}, {b}))"

    def array(self, *x):
        return f"array({', '.join(x)})"

    def each(self, x):
        return f"explode({x})"

    def ratio(self, a, b):
        return f"coalesce(try_divide(CAST({a} AS DOUBLE), {b}), 0D)"

    def undefined(self, a, b):
        return f"try_divide(CAST({a} AS DOUBLE), {b})"

    def extract(self, x, p, g=0):
        return f"regexp_extract({x}, '{p}', {g})"

    def matches(self, x, p):
        return f"({x} RLIKE '{p}')"

    def replace(self, x, p, r):
        return f"regexp_replace({x}, '{p}', '{r}')"

    def joined(self, x, sep, order):
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, CAST({x} AS STRING) AS x))), e -> e.x), {sep})"

    def int_div(self, a, b):
        return f"({a} div {b})"

    def json(self, x, k):
        return f"get_json_object({x}, '$.{k}')"

    def max_by(self, x, o):
        return f"max_by({x}, {o})"


class Duck(Dialect):
    spark = False

    def t(self, name):
        if name in TABLES:
            return name
        from spanalign.plans import bindings

        return f"({bindings.SQL[name](self)})"

    def sha(self, x):
        return f"sha256({x})"

    def hash32(self, x):
        return f"CAST('0x' || substr({x}, 1, 8) AS BIGINT)"

    def hash60(self, x):
        return f"CAST('0x' || substr({x}, 1, 15) AS BIGINT)"

    def size(self, x):
        return f"CAST(octet_length(encode({x})) AS BIGINT)"

    def pct(self, x, q):
        return f"quantile_cont({x}, {q})"

    def series(self, a, b):
        return f"unnest(generate_series({a}, {b}))"

    def array(self, *x):
        return f"[{', '.join(x)}]"

    def each(self, x):
        return f"unnest({x})"

    def ratio(self, a, b):
        return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"

    def undefined(self, a, b):
        return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"

    def extract(self, x, p, g=0):
        return f"regexp_extract({x}, '{_raw(p)}', {g})"

    def matches(self, x, p):
        return f"regexp_matches({x}, '{_raw(p)}')"

    def replace(self, x, p, r):
        return f"regexp_replace({x}, '{_raw(p)}', '{r}', 'g')"

    def joined(self, x, sep, order):
        return f"string_agg(CAST({x} AS VARCHAR), {sep} ORDER BY {order})"

    def int_div(self, a, b):
        return f"({a} // {b})"

    def json(self, x, k):
        return f"json_extract_string({x}, '$.{k}')"

    def max_by(self, x, o):
        return f"arg_max({x}, {o})"


def _raw(pattern: str) -> str:
    """Spark's literals take a backslash away, DuckDB's don't."""
    return pattern.replace("\\\\", "\\")


SPARK, DUCK = Dialect(), Duck()


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a binding derived from the tables; those of KEPT are made once in a query, whatever reads them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    from spanalign.plans import bindings

    if name in bindings.KEPT:
        made = _MADE.get()
        if made is None:
            return kept(bindings.FRAMES[name](spark, sf_dir))
        if (sf_dir, name) not in made:
            made[sf_dir, name] = kept(bindings.FRAMES[name](spark, sf_dir))
        return made[sf_dir, name]
    if name in bindings.FRAMES:
        return bindings.FRAMES[name](spark, sf_dir)
    return run_sql(spark, sf_dir, bindings.SQL[name](SPARK))


#: The kept bindings of the query that is being built.
_MADE: ContextVar[dict | None] = ContextVar("made", default=None)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    token = _MADE.set({}) if _MADE.get() is None else None
    try:
        return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in names})
    finally:
        if token is not None:
            _MADE.reset(token)


def shared(name: str):
    def register(make):
        QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, make(SPARK))
        ORACLES[name] = make(DUCK)
        MAKES[name] = make
        return make

    return register


def query(name: str, oracle=None):
    def register(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle(DUCK)
        return run

    return register
