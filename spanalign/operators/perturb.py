"""Deterministic noise and edit scripts on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.functions.bytesops import hash32, keyed_hash


def indent_noise(docs: DataFrame, rate: float, seed: int, key: str = "doc_id", text: str = "text", kept: tuple = ()) -> DataFrame:
    """key, n_edits, noised and what is kept beside them: each line is indented by two spaces with the given chance."""
    lines = F.split(text, "\n")

    def hit(i):
        return hash32(keyed_hash(F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))) < F.lit(rate * 4294967296)

    made = F.transform(lines, lambda x, i: F.struct(hit(i).alias("hit"), x.alias("x")))
    out = docs.select(key, *kept, made.alias("m"))
    noised = F.array_join(F.transform("m", lambda s: F.when(s["hit"], F.concat(F.lit("  "), s["x"])).otherwise(s["x"])), "\n")
    return out.select(key, *kept, F.size(F.filter("m", lambda s: s["hit"])).cast("long").alias("n_edits"), noised.alias("noised"))


def swap_letters(docs: DataFrame, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_changed: in each word of three letters or more two neighbours change places."""
    def swapped(w, i):
        j = F.pmod(hash32(keyed_hash(F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))), F.greatest(F.lit(1), F.length(w) - 1)).cast("int")
        new = F.concat(F.substring(w, F.lit(1), j), F.substring(w, j + 2, F.lit(1)), F.substring(w, j + 1, F.lit(1)), F.substring(w, j + 3, F.length(w)))
        return F.when(F.length(w) < 3, w).otherwise(new)

    words = F.split(text, " ")
    out = docs.select(key, F.transform(words, lambda w, i: F.struct(w.alias("old"), swapped(w, i).alias("new"))).alias("w"))
    return out.select(key, F.size("w").cast("long").alias("n_words"), F.size(F.filter("w", lambda s: s["old"] != s["new"])).cast("long").alias("n_changed"))


def insert_after(docs: DataFrame, pattern: str, what: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, edits: sorted disjoint (after, replacement) by the piece they follow."""
    return docs.select(key, F.transform(F.split(text, pattern), lambda x: x).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.lit(what).alias("what"))


def apply_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, edited: what stands between the edits and what they put there, joined in order."""
    found = F.transform("found", lambda x: F.concat(x, F.col("what")))
    joined = F.array_join(F.flatten(F.zip_with("pieces", found, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return docs.select(key).join(edits, key).select(key, joined.alias("edited"))
