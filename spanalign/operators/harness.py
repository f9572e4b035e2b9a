"""Alignment of several segmentations with the spans of whole texts, one Arrow pass for each text.

Scores, segments, proposers, spans and permutation nulls of a text are made where the text is; what
comes out are a few rows of counts for each text, which add up by group and by resample.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanalign.functions import scans
from spanalign.operators import resample, segment

COUNTS = "run string, edge string, tp bigint, fp bigint, fn bigint, null_tp double"
OVERLAPS = "layout string, total_iou double, n_spans bigint"
EDGES, LAYOUTS = ("start", "end"), ("model", "null", "line", "word")
#: Runs that need no scores.
PROPOSERS = ("newline", "indent_change", "word_start")
#: Segments of a text up to which its keys are held for the next run, and its orders are sorted from random words.
HELD, SORTED = 1 << 15, 3_000
#: Segments of replicates at once.
AT_ONCE = 1 << 15


class _Orders:
    """Ends of a text's segments but the last, in random order, some replicates at a time, as many as a cache holds.

    By hashed keys, which SQL can follow, or by a generator seeded by the text's key. A key is that of a
    text, a replicate and a place: all segmentations of a text and of its noised copy share them, so the
    keys of the last text are held.
    """

    def __init__(self, seed: int, reps: int, hashed: bool):
        self.seed, self.reps, self.hashed, self.name, self.keys = seed, reps, hashed, None, None

    def ends(self, name, lengths: np.ndarray):
        n = len(lengths) - 1
        some = max(1, AT_ONCE // (n + 1))
        rng = None if self.hashed else resample.generator(self.seed, name, n)
        for at in range(0, self.reps, some):
            reps = range(at, min(self.reps, at + some))
            moved = self._hashed(name, lengths[:-1], reps) if self.hashed else _shuffled(rng, lengths[:-1], len(reps))
            yield np.cumsum(moved, axis=1, dtype=np.int64)

    def _hashed(self, name, lengths: np.ndarray, reps: range) -> np.ndarray:
        n = len(lengths)
        if n > HELD:
            keys = self._digests(name, 0, n, reps)
        else:
            if self.name != name:
                self.name, self.keys = name, self._digests(name, 0, n, range(self.reps))
            elif self.keys.shape[1] < n:
                self.keys = np.concatenate([self.keys, self._digests(name, self.keys.shape[1], n, range(self.reps))], axis=1)
            keys = self.keys[reps.start : reps.stop, :n]
        first = keys[..., 0].astype(np.uint64)
        order = np.argsort(first, axis=1)
        ordered = np.take_along_axis(first, order, 1)
        if (ordered[:, 1:] == ordered[:, :-1]).any():  # the rest of the keys decides
            order = np.argsort(np.ascontiguousarray(keys).view("S32")[..., 0], axis=1, kind="stable")
        return lengths[order]

    def _digests(self, name, lo: int, hi: int, reps: range) -> np.ndarray:
        sha, places = hashlib.sha256, [b"\0%d" % p for p in range(lo + 1, hi + 1)]
        return np.frombuffer(b"".join([sha(head + p).digest() for head in (f"{self.seed}\0{name}\0{r}".encode() for r in reps) for p in places]), ">u8").reshape(len(reps), hi - lo, 4)


def _shuffled(rng, lengths: np.ndarray, n: int) -> np.ndarray:
    """n uniform orders: short lengths ride on random words of 24 bits that are sorted; where two words are the same, the row is drawn anew."""
    if not 1 < len(lengths) <= SORTED or lengths.max() > 255:
        return rng.permuted(np.broadcast_to(lengths, (n, len(lengths))), axis=1)
    words = rng.integers(0, 1 << 32, (n, len(lengths)), np.uint32)
    words &= np.uint32(0xFFFFFF00)
    words |= lengths.astype(np.uint32)
    words.sort(axis=1)
    same = np.flatnonzero(((words[:, 1:] ^ words[:, :-1]) < 256).any(1))
    words &= np.uint32(255)
    if len(same):
        words[same] = rng.permuted(np.broadcast_to(lengths.astype(np.uint32), (len(same), len(lengths))), axis=1)
    return words


def _dealt(docs: DataFrame, key: str) -> DataFrame:
    """Texts over many small tasks: what is done with them takes longer than moving them."""
    return docs.repartition(16 * docs.sparkSession.sparkContext.defaultParallelism, key)


def _columns(runs, scored) -> list[str]:
    return [f"{c}_{run}_{edge}" for run in runs for edge in EDGES for c in (("tp", "fp", "fn", "null") if run in scored else ("tp", "fp", "fn"))]


def counts_of(wide: DataFrame, scored, *keys: str) -> DataFrame:
    """keys and COUNTS: a row for each run and edge of the columns of alignment_wide."""
    runs = (*scored, *PROPOSERS)
    cells = ", ".join(f"'{run}', '{edge}', tp_{run}_{edge}, fp_{run}_{edge}, fn_{run}_{edge}, {f'null_{run}_{edge}' if run in scored else 'CAST(NULL AS DOUBLE)'}" for run in runs for edge in EDGES)
    return wide.selectExpr(*keys, f"stack({len(runs) * len(EDGES)}, {cells}) AS (run, edge, tp, fp, fn, null_tp)")


def _proposers(data: np.ndarray, ends: np.ndarray, word: str) -> dict:
    """(row, place) of the interior starts of lines, changed indents and words; places count from the buffer's start."""
    from spanalign.operators import baselines

    begins = np.concatenate([[0], ends[:-1]])
    out = {}
    for name, find in (("newline", baselines._newlines), ("indent_change", baselines._indent_changes), ("word_start", scans.matches(word))):
        row, columns = find(data, ends)
        place = columns[1 if name == "word_start" else 0]
        inside = (place > 0) & (place < (ends - begins)[row])
        out[name] = row[inside], (place + begins[row])[inside]
    return out


def alignment_wide(docs: DataFrame, taus: dict, span: str, word: str, reps: int, seed: int, hashed: bool = True, key: str = "doc_id", text: str = "text", other: str | None = None) -> DataFrame:
    """One row a text: tp, fp and fn of each run and edge of the spans, exact matches of interior offsets, and for the
    scored runs null, the mean number under ``reps`` permutations of their segments.

    Null and empty texts have no rows. With ``other``, a second text of each row (part 1) is counted beside the first (part 0).
    """
    runs = (*taus, *PROPOSERS)
    columns = _columns(runs, taus)

    def run(batches):
        orders = _Orders(seed, reps, hashed)
        for keys, data, ends in scans.texts(batches):
            begins = np.concatenate([[0], ends[:-1]])
            n = len(ends)
            names = keys.field(0).to_pylist()
            row, found = scans.matches(span)(data, ends)
            marks = np.zeros(len(data) + 1, np.uint8)
            wanted = {}
            for bit, edge in enumerate(EDGES):
                place = found[1 + bit]
                inside = (place > 0) & (place < (ends - begins)[row])
                marks[(place + begins[row])[inside]] |= 1 << bit
                at = np.flatnonzero(marks >> bit & 1)
                wanted[edge] = np.bincount(np.searchsorted(ends, at, "right"), minlength=n) if len(at) else np.zeros(n, np.int64)
            proposed = {name: (r, p) for name, (r, p) in _proposers(data, ends, word).items()}
            segments = {}
            for name, (_, r, start, length, _, _) in zip(taus, segment.cut(data, ends, taus.values()), strict=True):
                proposed[name] = r[start > 0], (start + begins[r])[start > 0]
                segments[name] = np.searchsorted(r, np.arange(n + 1)), length
            full = np.flatnonzero(ends > begins)
            out = {}
            for name, (r, place) in proposed.items():
                predicted = np.bincount(r, minlength=n)
                for bit, edge in enumerate(EDGES):
                    tp = np.bincount(r, marks[place] >> bit & 1, n).astype(np.int64)
                    out[f"tp_{name}_{edge}"], out[f"fp_{name}_{edge}"], out[f"fn_{name}_{edge}"] = tp, predicted - tp, wanted[edge] - tp
            for name in taus:
                out |= {f"null_{name}_{edge}": np.zeros(n) for edge in EDGES}
            for k in full.tolist():
                own = marks[begins[k] : ends[k]]
                for name, (first, length) in sorted(segments.items(), key=lambda x: x[1][0][k] - x[1][0][k + 1]):
                    for moved in orders.ends(names[k], length[first[k] : first[k + 1]]):
                        hit = own.take(moved)
                        for bit, edge in enumerate(EDGES):
                            out[f"null_{name}_{edge}"][k] += np.count_nonzero(hit & (1 << bit)) / reps
            kept = pa.array(full)
            yield pa.RecordBatch.from_arrays([keys.field(0).take(kept), keys.field(1).take(kept), *(pa.array(out[c][full]) for c in columns)], names=[key, "part", *columns])

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.selectExpr(key, f"CAST({text} AS BINARY) AS a", *([f"CAST({other} AS BINARY) AS b"] if other else []))
    texts = _dealt(texts, key).selectExpr(f"inline(array({', '.join(f'struct(struct({key}, {part} AS part) AS k, {c} AS x)' for part, c in enumerate('ab' if other else 'a'))}))")
    return texts.mapInArrow(run, f"{key} {kind}, part int, {', '.join(f'{c} double' if c.startswith('null') else f'{c} bigint' for c in columns)}")


def alignment(docs: DataFrame, taus: dict, span: str, word: str, reps: int, seed: int, hashed: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and COUNTS for every segmentation and both edges of the spans."""
    return counts_of(alignment_wide(docs, taus, span, word, reps, seed, hashed, key, text), taus, key)


def openers(docs: DataFrame, tau: float, span: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the spans behind byte 0 that open with a capital, or don't, and how many of these open a segment."""
    def run(batches):
        for keys, data, ends in scans.texts(batches):
            begins = np.concatenate([[0], ends[:-1]])
            row, found = scans.matches(span)(data, ends)
            inside = found[1] > 0
            row, place = row[inside], (found[1] + begins[row])[inside]
            opens = np.zeros(len(data) + 1, bool)
            _, cut_row, start, _, _, _ = next(segment.cut(data, ends, [tau]))
            opens[start + begins[cut_row]] = True
            capital = (data[place] >= 65) & (data[place] <= 90)
            sums = [np.bincount(row, x, len(ends)).astype(np.int64) for x in (capital, capital & opens[place], ~capital, ~capital & opens[place])]
            some = np.flatnonzero(sums[0] + sums[2])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), *(pa.array(x[some]) for x in sums)], names=[key, "n_capital", "hit_capital", "n_other", "hit_other"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(key, f"CAST({text} AS BINARY) AS {text}").mapInArrow(run, f"{key} {kind}, n_capital bigint, hit_capital bigint, n_other bigint, hit_other bigint")


def best_overlap(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The largest intersection over union of each span with any of the segments between the edges."""
    a, b = np.searchsorted(edges, starts, "right") - 1, np.searchsorted(edges, ends, "left") - 1

    def iou(k):
        low, high = edges[k], edges[k + 1]
        return (np.minimum(ends, high) - np.maximum(starts, low)) / (np.maximum(ends, high) - np.minimum(starts, low))

    best = np.maximum(iou(a), iou(b))
    # segments inside of the span: the longest one
    inner = b - a > 1
    if inner.any():
        sizes = np.concatenate([np.diff(edges), [0]])
        longest = np.maximum.reduceat(sizes, np.stack([a[inner] + 1, b[inner]], 1).ravel())[::2]
        best[inner] = np.maximum(best[inner], longest / (ends - starts)[inner])
    return best


def overlaps_wide(docs: DataFrame, tau: float, span: str, word: str, reps: int, seed: int, hashed: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text with spans: sums of the best overlap of each span with the segments, their permutations (the mean), lines and words, and the spans."""
    def run(batches):
        orders = _Orders(seed, reps, hashed)
        for keys, data, ends in scans.texts(batches):
            begins = np.concatenate([[0], ends[:-1]])
            names = keys.to_pylist()
            row, columns = scans.matches(span)(data, ends)
            _, cut_row, _, length, _, _ = next(segment.cut(data, ends, [tau]))
            proposed = _proposers(data, ends, word)
            out = []
            for k in np.flatnonzero(ends > begins).tolist():
                lo, hi = np.searchsorted(row, [k, k + 1])
                if lo == hi:
                    continue
                s, e, size = columns[1][lo:hi], columns[2][lo:hi], int(ends[k] - begins[k])
                lengths = length[slice(*np.searchsorted(cut_row, [k, k + 1]))]
                layouts = {"model": np.concatenate([[0], np.cumsum(lengths)])}
                for name, of in (("line", "newline"), ("word", "word_start")):
                    r, place = proposed[of]
                    layouts[name] = np.concatenate([[0], place[slice(*np.searchsorted(r, [k, k + 1]))] - begins[k], [size]])
                found = {name: best_overlap(s, e, edges).sum() for name, edges in layouts.items()}
                found["null"] = 0.0
                for moved in orders.ends(names[k], lengths):
                    # replicates stand one after another, a byte apart, so that all are searched at once
                    shift = np.arange(len(moved))[:, None] * (size + 1)
                    edges = np.concatenate([np.zeros((len(moved), 1), np.int64), moved, np.full((len(moved), 1), size)], 1) + shift
                    found["null"] += best_overlap((s + shift).ravel(), (e + shift).ravel(), edges.ravel()).sum() / reps
                out.append((names[k], *(float(found[x]) for x in LAYOUTS), hi - lo))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], keys.type), *(pa.array(c) for c in cols[1:5]), pa.array(cols[5], pa.int64())], names=[key, *LAYOUTS, "n_spans"])

    kind = docs.schema[key].dataType.simpleString()
    return _dealt(docs.selectExpr(key, f"CAST({text} AS BINARY) AS {text}"), key).mapInArrow(run, f"{key} {kind}, {', '.join(f'{x} double' for x in LAYOUTS)}, n_spans bigint")


def overlaps_of(wide: DataFrame, *keys: str) -> DataFrame:
    """keys and OVERLAPS: a row for each layout."""
    return wide.selectExpr(*keys, f"stack({len(LAYOUTS)}, {', '.join(f'{chr(39)}{x}{chr(39)}, `{x}`, n_spans' for x in LAYOUTS)}) AS (layout, total_iou, n_spans)")
