"""Boundary proposers that need no model: line starts and changes of indentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from spanalign.functions import scans


def _lines(data, ends):
    row, start, end = scans.line_table(data, ends)
    base = np.concatenate([[0], ends[:-1]])[row]
    size = np.diff(np.concatenate([[0], ends]))
    return row, [scans.numbers(row), size[row], start - base, scans.substrings(data, start, end)]


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, i, n, start_byte, line for every line, empty ones too; n is the text's length."""
    return scans.scan(docs.where(docs[text].isNotNull()), key, text, _lines, "i bigint, n bigint, start_byte bigint, line string")


def _newlines(data, ends):
    feeds = np.flatnonzero(data == 10)
    row, base = scans.owners(ends, feeds)
    inside = feeds + 1 < ends[row]
    return row[inside], [(feeds + 1 - base)[inside]]


def newlines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, byte_offset behind every line feed but one that ends the document."""
    return scans.scan(docs, key, text, _newlines, "byte_offset bigint")


def _indent_changes(data, ends):
    row, start, end = scans.line_table(data, ends)
    indent, full = scans.indents(data, start, end)
    row, start, indent = row[full], start[full], indent[full]
    before = np.concatenate([[0], indent[:-1]])
    before[np.flatnonzero(np.diff(row, prepend=-1))] = 0
    changed = indent != before
    base = np.concatenate([[0], ends[:-1]])[row]
    return row[changed], [(start + indent - base)[changed]]


def indent_changes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, byte_offset of the content of each line whose indent differs from the last line's.

    Lines of spaces, tabs and carriage returns only don't count; before the first line it is 0.
    """
    return scans.scan(docs, key, text, _indent_changes, "byte_offset bigint")
