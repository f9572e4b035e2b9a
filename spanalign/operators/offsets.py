"""Byte offsets, character offsets and token ids of whole texts, one Arrow pass each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanalign.functions.scans import scan

# The ids of the tokens before bytes, and the id of byte 0.
START_ID, BYTE_0 = 1, 4


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values))


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: the start token, then every byte plus BYTE_0; the start token alone for an empty or null text."""
    def find(data, ends):
        size = np.diff(np.concatenate([[0], ends]))
        ids = np.insert(data.astype(np.int32) + BYTE_0, ends - size, START_ID)
        return np.arange(len(ends)), [_lists(ids, size + 1)]

    return scan(docs, key, text, find, "ids array<int>")


def char_to_byte(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes: the byte offset of every character, and the length in bytes at the end."""
    def find(data, ends):
        begins = np.concatenate([[0], ends[:-1]])
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        row = np.searchsorted(ends, starts, "right")
        n = np.bincount(row, minlength=len(ends))
        local = np.insert(starts - begins[row], np.cumsum(n), ends - begins)
        return np.arange(len(ends)), [_lists(local, n + 1)]

    return scan(docs, key, text, find, "bytes array<bigint>")


def byte_to_char(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chars: for every byte offset, the length too, the character that starts there, or -1 inside of one."""
    def find(data, ends):
        size = np.diff(np.concatenate([[0], ends]))
        begins = ends - size
        first = (data & 0xC0) != 0x80
        seen = np.concatenate([[0], np.cumsum(first)])
        row = np.repeat(np.arange(len(ends)), size)
        local = np.where(first, seen[:-1] - seen[begins][row], -1)
        return np.arange(len(ends)), [_lists(np.insert(local, ends, seen[ends] - seen[begins]), size + 1)]

    return scan(docs, key, text, find, "chars array<bigint>")


def is_char_boundary(text: str, offset: str) -> Column:
    """Whether a byte offset, the length included, stands before a character; false outside of the text."""
    size = f"octet_length({text})"
    byte = f"conv(hex(substring(CAST({text} AS BINARY), CAST({offset} AS INT) + 1, 1)), 16, 10)"
    return F.expr(f"coalesce({offset} >= 0 AND {offset} <= {size} AND ({offset} = {size} OR (CAST({byte} AS INT) & 192) <> 128), false)")


def converted(table: DataFrame, maps: DataFrame, key: str, offset: str, of: str) -> DataFrame:
    """table with ``converted`` and ``problem``: the offset through the map ``of`` of its text's maps.

    The problem is null, 'outside', or 'inside_character'; the offset of a problem is null.
    """
    value = F.expr(f"IF({offset} >= 0 AND {offset} < size({of}), get({of}, CAST({offset} AS INT)), NULL)")
    rows = table.join(maps.select(key, of), key, "left").withColumn("converted", value).drop(of)
    problem = F.when(F.col("converted").isNull(), "outside").when(F.col("converted") < 0, "inside_character")
    return rows.withColumn("problem", problem).withColumn("converted", F.when(problem.isNull(), F.col("converted")))


def byte_scores(token_scores: str) -> Column:
    """Scores of bytes from those of tokens: a token's score is about the token behind it, so that the last one is about none."""
    return F.expr(f"slice({token_scores}, 1, greatest(size({token_scores}) - 1, 0))")


def patch_byte_starts(lengths: str, n_bytes: str) -> Column:
    """Byte starts of patches from their lengths in tokens, of which the first is the start token; empty patches don't count."""
    kept = f"filter({lengths}, x -> x > 0)"
    ends = f"aggregate(slice({kept}, 1, greatest(size({kept}) - 1, 0)), array(0L), (a, x) -> concat(a, array(a[size(a) - 1] + x)))"
    return F.expr(f"transform(filter({ends}, x -> x >= 1 AND x - 1 < {n_bytes}), x -> x - 1)")


def start_ids(scores: str, tau: float, to_last: bool = True) -> Column:
    """Token places at which patches start: 0 and 1, then behind every token but the first with a score above tau.

    Without to_last the last token starts nothing behind it.
    """
    last = "" if to_last else f" AND p.i < size({scores}) - 1"
    return F.expr(f"concat(array(0, 1), transform(filter(transform({scores}, (x, i) -> struct(x AS x, i AS i)), p -> p.i >= 1 AND CAST(p.x AS DOUBLE) > {tau!r}{last}), p -> p.i + 1))")
