"""Arrow passes over the bytes of texts: every row's offsets come out in order, without any shuffle.

A scan gets the bytes of many texts at once, at most CHUNK unless one text alone is longer, and
returns the places of what it found, which are split by text again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4 << 20


def texts(batches):
    """(key, text) batches -> (keys, bytes, ends) of runs of rows; a null text is an empty one."""
    for batch in batches:
        keys = batch.column(0)
        text = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            yield keys.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
            at = to


def owners(ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each place, and where that text starts."""
    row = np.searchsorted(ends, places, "right")
    return row, np.concatenate([[0], ends])[row]


def numbers(row: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of equal rows."""
    if not len(row):
        return row
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))


def scan(df: DataFrame, key: str, text: str, find, schema: str) -> DataFrame:
    """key and what find(bytes, ends) -> (row, columns) finds, as rows of schema."""
    names = [key, *(f.split()[0] for f in schema.split(", "))]

    def run(batches):
        for keys, data, ends in texts(batches):
            row, columns = find(data, ends)
            for lo in range(0, len(row), 1 << 18):
                some = slice(lo, lo + (1 << 18))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[some])), *(c[some] if isinstance(c, np.ndarray) is False else pa.array(c[some]) for c in columns)], names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("binary").alias(text)).mapInArrow(run, f"{key} {kind}, {schema}")


def substrings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings between places, which must not overlap and must be in order."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    step = np.zeros(len(data) + 1, np.int8)
    step[starts[size > 0]] += 1
    step[ends[size > 0]] -= 1
    kept = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.string())


def matches(pattern: str):
    """Matches of a pattern of ASCII classes, which never holds a part of a character only."""
    find_all = re.compile(pattern.encode("ascii")).finditer

    def find(data, ends):
        places, first = [], 0
        raw = data.tobytes()
        for end in ends.tolist():
            # a match doesn't cross the end of a text
            places += [x for m in find_all(raw[first:end]) for x in (m.start() + first, m.end() + first)]
            first = end
        spans = np.array(places, np.int64).reshape(-1, 2)
        row, base = owners(ends, spans[:, 0])
        return row, [numbers(row), spans[:, 0] - base, spans[:, 1] - base, substrings(data, spans[:, 0], spans[:, 1])]

    return find


def line_table(data: np.ndarray, ends: np.ndarray):
    """(row, start, end) of every line, empty ones too; an empty text has one."""
    feeds = np.flatnonzero(data == 10)
    row_of_feed, _ = owners(ends, feeds)
    begins = np.concatenate([[0], ends[:-1]])
    # a line starts with its text and behind every feed; it ends at the next feed or with its text
    row = np.concatenate([np.arange(len(ends)), row_of_feed])
    start = np.concatenate([begins, feeds + 1])
    end = np.concatenate([feeds, ends])
    end_row = np.concatenate([row_of_feed, np.arange(len(ends))])
    order, end_order = np.lexsort([start, row]), np.lexsort([end, end_row])
    return row[order], start[order], end[end_order]


def indents(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of blanks that each line begins with, whether it holds more than blanks and returns)."""
    blank = (data == 32) | (data == 9)
    full = ~blank & (data != 13)
    # the next byte that is no blank, from each place on
    stops = np.concatenate([np.flatnonzero(~blank), [len(data)]])
    first = np.minimum(stops[np.searchsorted(stops[:-1], start)], end)
    seen = np.concatenate([[0], np.cumsum(full)])
    return first - start, seen[end] > seen[start]
