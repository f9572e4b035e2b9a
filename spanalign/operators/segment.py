"""Threshold segmentation of per-byte scores and its statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanalign.functions.bytesops import mock_scores
from spanalign.functions.scans import numbers, scan


def patch_starts(scores: str, tau: float) -> Column:
    """ARRAY<STRUCT<start, trigger, score>>: byte 0 and every later byte with score > tau, strictly."""
    return F.expr(
        f"""filter(transform({scores}, (x, i) -> struct(CAST(i AS BIGINT) AS start,
          IF(i = 0, 'init', 'entropy') AS trigger, x AS score)), p -> p.start = 0 OR CAST(p.score AS DOUBLE) > {tau!r})"""
    )


TRIGGERS = ("init", "entropy", "length_cap")


def cut(data: np.ndarray, ends: np.ndarray, taus, max_length: int | None = None):
    """The segments of many texts under each threshold, scores made once: (tau, row, start, length, trigger, score) each.

    Starts count from the text's own; the trigger is a number of TRIGGERS.
    """
    score = mock_scores(data, ends)
    begins = np.concatenate([[0], ends[:-1]])
    for tau in taus:
        start = score.astype(np.float64) > tau
        start[begins[begins < ends]] = True
        at = np.flatnonzero(start)
        row = np.searchsorted(ends, at, "right")
        stop = np.minimum(np.concatenate([at[1:], [len(data)]]), ends[row])
        trigger, seen, known = (at != begins[row]).astype(np.int8), score[at], np.ones(len(at), bool)
        if max_length:
            parts = -(-(stop - at) // max_length)
            k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            row, seen, stop = (np.repeat(x, parts) for x in (row, seen, stop))
            at = np.repeat(at, parts) + max_length * k
            stop = np.minimum(stop, at + max_length)
            trigger, known = np.where(k > 0, 2, np.repeat(trigger, parts)), k == 0
        yield tau, row, at - begins[row], stop - at, trigger, pa.array(seen, pa.float32(), mask=~known)


def patches(docs: DataFrame, tau: float, max_length: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, patch_index, start_byte, patch_length, trigger, score; a null or empty text has no rows.

    One pass over the bytes, no shuffle. With max_length, longer patches are cut at its multiples; the
    further parts have the trigger length_cap and no score above tau.
    """
    def find(data, ends):
        _, row, start, length, trigger, score = next(cut(data, ends, [tau], max_length))
        names = pa.DictionaryArray.from_arrays(pa.array(trigger, pa.int8()), pa.array(TRIGGERS)).cast(pa.string())
        return row, [numbers(row).astype(np.int32), start, length.astype(np.int32), names, score]

    return scan(docs, key, text, find, "patch_index int, start_byte bigint, patch_length int, trigger string, score float")


def length_histograms(docs: DataFrame, tau: float, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bin, n: how many patches of a text have which length, those over ``most`` as that."""
    def find(data, ends):
        _, row, _, length, _, _ = next(cut(data, ends, [tau]))
        cells, n = np.unique(row * (most + 1) + np.minimum(length, most), return_counts=True)
        return cells // (most + 1), [(cells % (most + 1)).astype(np.int32), n.astype(np.int64)]

    return scan(docs, key, text, find, "bin int, n bigint")


def _sums(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, x, n)


def _quantile(ordered: np.ndarray, first: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """Linear quantiles of the runs of an array that is sorted inside of each."""
    at = (n - 1) * q
    low = np.floor(at).astype(np.int64)
    a, b = ordered[first + low], ordered[first + np.minimum(low + 1, n - 1)]
    return a + (b - a) * (at - low)


SUMMARY = (
    "tau double, n_patches bigint, n_bytes bigint, mean_bpp double, var_bpp double, min_bpp int, max_bpp int, n_init bigint, n_entropy bigint, n_length_cap bigint, "
    "p10_bpp double, median_bpp double, p90_bpp double, ent_mean double, ent_max double, frac_above_tau double, total_milli bigint, n_high bigint"
)


def summaries(docs: DataFrame, taus, max_length: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and SUMMARY of each text under each threshold: bytes per patch, triggers, and the scores themselves.

    Scores are made once for all thresholds, and a text's row is summed where it is; a null or empty text has no row.
    """
    def find(data, ends):
        n_rows = len(ends)
        size = np.diff(np.concatenate([[0], ends]))
        full = size > 0
        row_of = np.repeat(np.arange(n_rows), size)
        score = mock_scores(data, ends).astype(np.float64)
        mean = _sums(row_of, score, n_rows) / np.maximum(size, 1)
        largest = np.zeros(n_rows)
        largest[full] = np.maximum.reduceat(score, (ends - size)[full]) if full.any() else 0
        milli = _sums(row_of, np.rint(score * 1000), n_rows).astype(np.int64)
        high = _sums(row_of, score > 1, n_rows).astype(np.int64)
        out = []
        for tau, row, _, length, trigger, _ in cut(data, ends, taus, max_length):
            above = _sums(row_of, score > tau, n_rows) / np.maximum(size, 1)
            order = np.lexsort([length, row])
            n = np.bincount(row, minlength=n_rows)
            first = np.cumsum(n) - n
            ordered = length[order].astype(np.float64)
            average = size / np.maximum(n, 1)
            spread = _sums(row, (length - average[row]) ** 2, n_rows) / np.maximum(n, 1)
            here = np.flatnonzero(full)
            first, n_here = first[here], n[here]
            kinds = [np.bincount(row[trigger == k], minlength=n_rows)[here] for k in range(3)]
            out.append((here, [np.full(len(here), tau), n_here, size[here], average[here], spread[here], ordered[first].astype(np.int32), ordered[first + n_here - 1].astype(np.int32), *kinds,
                               *(_quantile(ordered, first, n_here, q) for q in (0.1, 0.5, 0.9)), mean[here], largest[here], above[here], milli[here], high[here]]))
        return np.concatenate([r for r, _ in out]), [np.concatenate(c) for c in zip(*(c for _, c in out), strict=True)]

    return scan(docs, key, text, find, SUMMARY)
