"""Removal of long repeated byte strings by blockwise suffix sorting over a difference cover.

A string of WIDTH bytes repeats if the suffixes that start with it tie over WIDTH bytes. Sorting all
suffixes at once would take many times the text; instead

1. only the suffixes at places of a difference cover are ranked, by their first KEY bytes. For any
   two suffixes some common shift below PERIOD puts both on the cover, and KEY + PERIOD - 1 = WIDTH:
   suffixes without a tied cover place in their first PERIOD bytes have no tie of WIDTH bytes. Ranks
   are 32 bits inside a range of ranks; two strings of one rank only make a candidate;
2. the others are dealt into buckets by the least rank among the strings of KEY bytes in their first
   WIDTH bytes. Neighbouring suffixes mostly fall into the same bucket and travel as one piece of
   text, a byte or so more than four for each suffix. One bucket of suffixes is sorted after another,
   by names of their first WIDTH bytes; ties are held against the bytes themselves, and the smallest
   document of each tie keeps the string.

Inside a part of a block equal pieces are resolved before anything is sent: a string that a third of
all documents share is sent once for each part. A long text is taken in parts, a long bucket in
chunks, of which only the distinct strings are carried on. A string of KEY bytes that is common in the
corpus makes a bucket that grows with it: one of more than HELD strings goes to temporary files by name
and is resolved file by file.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import Workspace, lean, table
from spanalign.llm.runs import runs
from spanalign.llm.shingles import constants, mix

WIDTH = 50
# A perfect difference set, every residue is a difference of two of its members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
KEY = WIDTH - PERIOD + 1
BLOCK = 4 << 20
#: Bytes of text that are hashed at once: whole periods.
PART = PERIOD << 16
#: Bytes of text for each range of ranks, and of buckets, that one reducer sorts.
RANK_RANGE = 4 << 20
RANGE = 2 << 20
#: Suffixes that are sorted at once.
CHUNK = 1 << 19
#: Suffixes of a bucket that are held in memory, and the files, by so many bits of the name, that take more.
HELD = 1 << 20
BITS = 4
#: Parts into which the copies of one text are dealt.
SALT = 64
NO_KEY = 1 << 62

_U = np.uint64
_MULTIPLIERS = constants(8, 11)
#: Places from which eight bytes each make up KEY, and WIDTH, bytes.
_KEY_AT = (0, 8, KEY - 8)
_WIDTH_AT = (0, 8, 16, 24, 32, 40, WIDTH - 8)
#: A block is a page and a row group: a reader holds one at a time, not all those of a file.
ROW_BY_ROW = {"parquet.block.size": BLOCK, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
BLOCK_SQL = "g bigint, ids binary, hashes binary, ends binary, data binary"
RANKS = "r bigint, g bigint, known boolean, h binary, pos binary, id binary, n binary"
PIECES = "r bigint, g bigint, known boolean, data binary, pos binary, len binary, id binary, n binary"


def blocks(batches):
    """(id, th, text) -> rows of BLOCK_SQL: some whole texts each, as int64, int64, int64 and bytes."""
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 32, 0
    ids, hashes, data, size = [], [], [], 0

    def row():
        ends = np.cumsum([len(d) for d in data], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([base + made], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), np.array(hashes, np.int64).tobytes(), ends.tobytes(), b"".join(data)))],
            names=["g", "ids", "hashes", "ends", "data"],
        )

    for batch in batches:
        for i, th, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (t or "").encode()
            if size and size + len(raw) > BLOCK:
                yield row()
                made += 1
                ids, hashes, data, size = [], [], [], 0
            ids.append(i)
            hashes.append(th)
            data.append(raw)
            size += len(raw)
    if ids:
        yield row()


def _words(data) -> np.ndarray:
    """The eight bytes from every place on, as numbers."""
    a = np.frombuffer(data, np.uint8)
    out = np.empty(max(0, len(a) - 7), _U)
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(a, "<u8", (len(a) - k) // 8, k)[: len(out[k::8])]
    return out


def _names(words) -> np.ndarray:
    """64-bit names of the strings that the words make up together."""
    h = None
    for w, m in zip(words, _MULTIPLIERS, strict=False):
        h = w * m if h is None else (h ^ w) * m
        h ^= h >> _U(32)
    return mix(h)


def _parts(n: int):
    """(from, to) of each part's places; a part's strings may reach WIDTH bytes beyond it."""
    return [(lo, min(n, lo + PART)) for lo in range(0, n, PART)]


def _runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal values."""
    if not len(x):
        return x, np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[starts], np.diff(np.concatenate([starts, [len(x)]]))


def _planes(a: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: the high ones, mostly zero, compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _numbers(raw: bytes, kind) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(n, len(raw) // n).T).view(kind).ravel()


def _steps(a: np.ndarray) -> bytes:
    """Ascending places as their differences, which compress well."""
    return _planes(np.diff(a, prepend=np.int64(0)).astype(np.uint32))


def _places(raw: bytes) -> np.ndarray:
    return np.cumsum(_numbers(raw, np.uint32), dtype=np.int64)


def _batch(schema: str, rows: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _by_range(r: np.ndarray):
    """Order by range that keeps the order inside of each, and (range, from, to) of each."""
    order = np.argsort(r, kind="stable")
    values, n = _runs_of(r[order])
    ends = np.cumsum(n)
    return order, list(zip(values.tolist(), (ends - n).tolist(), ends.tolist(), strict=True))


def _edges_of_ties(order: np.ndarray, h: np.ndarray, ids: np.ndarray):
    """(least id, greatest id, size) of each group of equal names in the order."""
    values, n = _runs_of(h[order])
    if not len(n):
        return n, n, n
    starts, by = np.cumsum(n) - n, ids[order]
    return np.minimum.reduceat(by, starts), np.maximum.reduceat(by, starts), n


def _blocks_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(j)[k] for j, n in enumerate(batch.schema.names)}
            hits = row["hits"].as_py() if "hits" in row else None
            yield row["g"].as_py(), row["data"].as_buffer(), *(np.frombuffer(row[c].as_buffer(), np.int64) for c in ("ids", "hashes", "ends")), hits or []


def _ranks(words: np.ndarray, at) -> np.ndarray:
    return _names([words[at + k] if isinstance(at, np.ndarray) else words[at.start + k : at.stop + k] for k in _KEY_AT])


def sampler(ranges: int):
    """Step 1: ranks of KEY bytes at the cover's places, and which are tied inside of a part."""
    def run(batches):
        with np.errstate(over="ignore"):
            for g, data, ids, _, ends, _ in _blocks_of(batches):
                for lo, hi in _parts(len(data)):
                    words = _words(data[lo : hi + WIDTH])
                    places = (np.arange(-(-(hi - lo) // PERIOD))[:, None] * PERIOD + np.array(COVER)).ravel()
                    places = places[places < hi - lo]
                    doc = np.searchsorted(ends, places + lo, "right")
                    inside = places + lo + KEY <= ends[doc]
                    places, by = places[inside], ids[doc[inside]]
                    h = _ranks(words, places)
                    order = np.argsort(h)
                    least, greatest, n = _edges_of_ties(order, h, by)
                    tied = np.repeat(least != greatest, n)
                    send = np.empty(len(h), bool)
                    send[order] = ~tied
                    # one row of the least and one of the greatest key: of one key alone, others of that key would see no tie
                    at, group = order[tied], np.repeat(np.arange(len(n)), n)[tied]
                    for edge in (least, greatest):
                        some = by[at] == edge[group]
                        send[at[some][np.diff(group[some], prepend=-1) != 0]] = True
                    rows = []
                    if len(at):
                        rows.append((g % ranges, g, True, None, _steps(np.sort(places[at]) + lo), None, None))
                    keep = np.flatnonzero(send)
                    r = ((h[keep] & _U(0xFFFFFFFF)) % _U(ranges)).astype(np.int64)
                    order, cuts = _by_range(r)
                    keep = keep[order]
                    short, place, by = (h[keep] >> _U(32)).astype(np.uint32), places[keep] + lo, by[keep]
                    for value, a, b in cuts:
                        who, many = _runs_of(by[a:b])
                        rows.append((value, g, False, short[a:b].tobytes(), _steps(place[a:b]), _planes(who), many.astype(np.uint32).tobytes()))
                    if rows:
                        yield _batch(RANKS, rows)

    return run


def _open(rows: pa.Table, kind: str):
    """The rows that have an answer already as (g, hit); the others."""
    known = rows.column("known")
    direct = rows.filter(known)
    done = pa.RecordBatch.from_arrays([pc.cast(direct.column("g").combine_chunks(), pa.int64()), pc.cast(direct.column(kind).combine_chunks(), pa.binary())], names=["g", "hit"])
    return done, rows.filter(pc.invert(known))


def _owners(part) -> np.ndarray:
    return np.concatenate([np.repeat(_numbers(a, np.int64), np.frombuffer(n, np.uint32)) for a, n in zip(part.column("id").to_pylist(), part.column("n").to_pylist(), strict=True)])


def tied_ranks(batches):
    """RANKS sorted by r -> (g, hit): places of the cover that tie with one of another document."""
    for rows in runs(batches, "r"):
        done, rows = _open(rows, "pos")
        if done.num_rows:
            yield done
        r = rows.column("r").to_numpy()
        _, n = _runs_of(r)
        for a, k in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
            part = rows.slice(a, k)
            hs = [np.frombuffer(x, np.uint32) for x in part.column("h").to_pylist()]
            h, ids = np.concatenate(hs), _owners(part)
            order = np.argsort(h)
            least, greatest, n_of = _edges_of_ties(order, h, ids)
            hit = np.empty(len(h), bool)
            hit[order] = np.repeat(least != greatest, n_of)
            out, at = [], 0
            for g, x, p in zip(part.column("g").to_pylist(), hs, part.column("pos").to_pylist(), strict=True):
                some = hit[at : at + len(x)]
                at += len(x)
                if some.any():
                    out.append((g, _steps(_places(p)[some])))
            if out:
                yield _batch("g bigint, hit binary", out)


def _sliding(x: np.ndarray, op) -> np.ndarray:
    """op over each PERIOD neighbours."""
    width = 1
    while 2 * width <= PERIOD:
        x = op(x[:-width], x[width:])
        width *= 2
    rest = PERIOD - width
    return op(x[:-rest], x[rest:]) if rest else x


def _candidates(lo: int, hi: int, ends: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Whether the string of WIDTH bytes from each place lo..hi on is inside a document and holds a tied place in its first PERIOD bytes."""
    tied = np.zeros(hi - lo + PERIOD - 1, bool)
    a, b = np.searchsorted(hits, [lo, hi + PERIOD - 1])
    tied[hits[a:b] - lo] = True
    some = _sliding(tied, np.logical_or)
    a, b = np.searchsorted(ends, [lo, hi + WIDTH], "right")
    late = (np.unique(ends[a : b + 1])[:, None] - np.arange(1, WIDTH)).ravel() - lo
    some[late[(late >= 0) & (late < hi - lo)]] = False
    return some


def _pieces_of(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> pa.Array:
    """The texts of the pieces: all WIDTH bytes of each of their n suffixes."""
    size = n + WIDTH - 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat((starts - offsets[:-1]).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def sorter(ranges: int):
    """Step 2: the suffixes that step 1 leaves a tie possible for, as pieces of text dealt by their bucket."""
    def run(batches):
        with np.errstate(over="ignore"):
            for g, data, ids, _, ends, hits in _blocks_of(batches):
                if not hits:
                    continue
                tied = np.unique(np.concatenate([_places(x) for x in hits]))
                whole = np.frombuffer(data, np.uint8)
                for lo, hi in _parts(len(data)):
                    starts = np.flatnonzero(_candidates(lo, hi, ends, tied))
                    if not len(starts):
                        continue
                    text = whole[lo : hi + WIDTH]
                    words = _words(text)
                    ranks = (_ranks(words, slice(0, len(text) - KEY + 1)) >> _U(32)).astype(np.uint32)
                    del words
                    bucket = _sliding(ranks, np.minimum)[starts]
                    cut = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(bucket) != 0)]))
                    n = np.diff(np.concatenate([cut, [len(starts)]]))
                    starts, r = starts[cut], (mix(bucket[cut].astype(_U)) % _U(ranges)).astype(np.int64)
                    order, _ = _by_range(r)
                    starts, n, r = starts[order], n[order], r[order]
                    by = ids[np.searchsorted(ends, starts + lo, "right")]
                    texts = _pieces_of(text, starts, n)
                    same = pc.dictionary_encode(texts).indices.to_numpy()
                    order = np.argsort(same, kind="stable")
                    least, _, size = _edges_of_ties(order, same, by)
                    kept = by == least[same]
                    rows = []
                    if not kept.all():
                        rows.append((g % ranges, g, True, _spans(starts[~kept] + lo, n[~kept]), None, None, None, None))
                        texts, starts, n, r, by = texts.filter(pa.array(kept)), starts[kept], n[kept], r[kept], by[kept]
                    raw, offsets = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int32)
                    for value, a, b in _by_range(r)[1]:
                        who, many = _runs_of(by[a:b])
                        rows.append((value, g, False, raw[int(offsets[a]) : int(offsets[b])].to_pybytes(), _steps(starts[a:b] + lo), n[a:b].astype(np.uint32).tobytes(), _planes(who), many.astype(np.uint32).tobytes()))
                    yield _batch(PIECES, rows)

    return run


def _spans(starts: np.ndarray, n: np.ndarray) -> bytes:
    return np.stack([starts, n], 1).astype(np.uint32).tobytes()


def _order_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal strings side by side, what is equal just where they are, and their names."""
    names = h = _names(words)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    left, right = order[:-1][same], order[1:][same]
    if any((w[left] != w[right]).any() for w in words):
        # two strings of one name: the bytes decide
        order = np.lexsort(words)
        h = np.empty(len(order), _U)
        h[order] = np.cumsum(np.concatenate([[0], (np.diff(words[:, order].view(np.int64), axis=1) != 0).any(0)]))
    return order, h, names


class _Bucket:
    """Suffixes of one bucket, sorted so far: their bytes, owners and places. More than HELD go to files."""

    def __init__(self):
        self.words = np.empty((len(_WIDTH_AT), 0), _U)
        self.ids = self.g = self.pos = np.empty(0, np.int64)
        self.files = None

    def add(self, part: pa.Table):
        """Sorts a chunk in; yields (g, hit), spans of suffixes that tie with a smaller document."""
        texts = part.column("data").to_pylist()
        lens = [np.frombuffer(x, np.uint32).astype(np.int64) for x in part.column("len").to_pylist()]
        n = np.concatenate(lens)
        size = n + WIDTH - 1
        first = np.cumsum(n) - n
        at = np.repeat(np.cumsum(size) - size - first, n) + np.arange(int(n.sum()))
        pos = np.repeat(np.concatenate([_places(x) for x in part.column("pos").to_pylist()]) - first, n) + np.arange(len(at))
        g = np.repeat(np.repeat(part.column("g").to_numpy(), [len(x) for x in lens]), n)
        raw = b"".join(texts)
        view = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
        words = np.stack([view[at + k] for k in _WIDTH_AT])
        if len(self.ids):
            words = np.concatenate([self.words, words], 1)
            pos, g = np.concatenate([self.pos, pos]), np.concatenate([self.g, g])
        ids = np.concatenate([self.ids, np.repeat(_owners(part), n)])
        order, h, names = _order_of(words)
        least, _, n_of = _edges_of_ties(order, h, ids)
        hit = np.empty(len(ids), bool)
        hit[order] = ids[order] > np.repeat(least, n_of)
        yield from _hits(g[hit], pos[hit])
        self.words, self.ids, self.g, self.pos = words[:, ~hit], ids[~hit], g[~hit], pos[~hit]
        if self.files or len(self.ids) > HELD:
            self.files = self.files or _files()
            _deal(_records(names[~hit], self.words, self.ids, self.g, self.pos), self.files, 0)
            self.words, self.ids, self.g, self.pos = self.words[:, :0], self.ids[:0], self.g[:0], self.pos[:0]

    def close(self):
        """Yields (g, hit) of what went to files."""
        for f in self.files or []:
            yield from _resolved(f, 1)


_RECORD = np.dtype([("name", "<u8"), ("id", "<i8"), ("g", "<i8"), ("pos", "<i8"), ("words", "<u8", (len(_WIDTH_AT),))])


def _files() -> list:
    return [tempfile.TemporaryFile() for _ in range(1 << BITS)]


def _records(names, words, ids, g, pos) -> np.ndarray:
    out = np.empty(len(ids), _RECORD)
    out["name"], out["id"], out["g"], out["pos"], out["words"] = names, ids, g, pos, words.T
    return out


def _deal(records: np.ndarray, files: list, level: int) -> None:
    """Appends records to files by the bits of their names that belong to the level."""
    k = ((records["name"] >> _U(BITS * level)) & _U((1 << BITS) - 1)).astype(np.int64)
    order, cuts = _by_range(k)
    for value, a, b in cuts:
        files[value].write(records[order[a:b]].tobytes())


def _chunks(f):
    """The records of a file, some at a time."""
    f.seek(0)
    while raw := f.read(_RECORD.itemsize * CHUNK):
        yield np.frombuffer(raw, _RECORD)


def _resolved(f, level: int):
    """(g, hit) of a file's records: first the smallest document of each string, then who else has it."""
    with f:
        words, least = np.empty((len(_WIDTH_AT), 0), _U), np.empty(0, np.int64)
        for x in _chunks(f):
            words, ids = np.concatenate([words, x["words"].T], 1), np.concatenate([least, x["id"]])
            order, h, _ = _order_of(words)
            least, _, n = _edges_of_ties(order, h, ids)
            words = words[:, order[np.cumsum(n) - n]]
            if len(least) > HELD and BITS * (level + 1) <= 64:
                break
        else:
            for x in _chunks(f):
                order, h, _ = _order_of(np.concatenate([words, x["words"].T], 1))
                some, _, n = _edges_of_ties(order, h, np.concatenate([least, x["id"]]))
                smallest = np.empty(len(order), np.int64)
                smallest[order] = np.repeat(some, n)
                hit = x["id"] > smallest[len(least) :]
                yield from _hits(x["g"][hit], x["pos"][hit])
            return
        del words, least, ids, order, h, n
        files = _files()
        for x in _chunks(f):
            _deal(x, files, level)
    for f in files:
        yield from _resolved(f, level + 1)


def _hits(gs: np.ndarray, ps: np.ndarray):
    """(g, hit): places as spans, of neighbours that stand in a row."""
    if len(gs):
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(gs) != 0) | (np.diff(ps) != 1)]))
        many = np.diff(np.concatenate([cut, [len(gs)]]))
        gs, ps = gs[cut], ps[cut]
        values, k = _runs_of(gs)
        ends = np.cumsum(k)
        yield _batch("g bigint, hit binary", [(v, _spans(ps[b - m : b], many[b - m : b])) for v, m, b in zip(values.tolist(), k.tolist(), ends.tolist(), strict=True)])


def tied_suffixes(batches):
    """PIECES sorted by r -> (g, hit): spans of suffixes that tie with one of a smaller document."""
    with np.errstate(over="ignore"):
        last, bucket = None, None
        for batch in batches:
            done, rows = _open(pa.Table.from_batches([batch]), "data")
            if done.num_rows:
                yield done
            _, n = _runs_of(rows.column("r").to_numpy())
            for a, k in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
                part = rows.slice(a, k)
                if part.column("r")[0].as_py() != last:
                    if bucket:
                        yield from bucket.close()
                    last, bucket = part.column("r")[0].as_py(), _Bucket()
                size = pc.binary_length(part.column("len")).to_numpy().astype(np.int64)
                size = pc.binary_length(part.column("data")).to_numpy() - (WIDTH - 1) * (size // 4)
                chunk = (np.cumsum(size) - size) // CHUNK
                _, m = _runs_of(chunk)
                for b, c in zip((np.cumsum(m) - m).tolist(), m.tolist(), strict=True):
                    yield from bucket.add(part.slice(b, c))
        if bucket:
            yield from bucket.close()


def _step(text: DataFrame, make, schema: str, resolve, ranges: int, work: Workspace) -> tuple[DataFrame, str]:
    """(g, hits), all hits by block, and the table that it reads."""
    sent = text.mapInArrow(lean(make(ranges)), schema).repartition("r").sortWithinPartitions("r")
    path = work.write(sent.mapInArrow(lean(resolve), "g bigint, hit binary"))
    del sent  # its shuffle files go with it
    work.release()
    return work.read(path, schema="g bigint, hit binary").groupBy("g").agg(F.collect_list("hit").alias("hits")), path


def _whole(data: bytes, covered: np.ndarray) -> np.ndarray:
    """covered without characters of which a part would stay."""
    a = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((a & 0xC0) != 0x80)
    if not len(starts):
        return covered
    n = np.diff(np.concatenate([starts, [len(a)]]))
    return np.repeat(np.logical_and.reduceat(covered, starts), n)


def _covered(n: int, hits: list[bytes]) -> np.ndarray:
    """Bytes that the spans of suffixes cover with their WIDTH bytes."""
    spans = np.frombuffer(b"".join(hits), np.uint32).astype(np.int64).reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0])]
    starts, ends = spans[:, 0], np.maximum.accumulate(spans.sum(1) + WIDTH - 1)
    step = np.zeros(n + 1, np.int8)
    if len(spans):
        new = np.concatenate([[True], starts[1:] > ends[:-1]])
        step[starts[new]] = 1
        step[ends[np.concatenate([new[1:], [True]])]] = -1
    return np.cumsum(step, dtype=np.int8)[:n].view(bool)


FINISHED = "id bigint, th bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def finish(with_text: bool):
    def run(batches):
        for _, data, ids, hashes, ends, hits in _blocks_of(batches):
            covered = _covered(len(data), hits)
            data = data.to_pybytes()
            out, at = [], 0
            for i, th, end in zip(ids.tolist(), hashes.tolist(), ends.tolist(), strict=True):
                mask, raw = covered[at:end], data[at:end]
                at = end
                n = int(mask.sum())
                spans = int(np.count_nonzero(np.diff(np.concatenate([[False], mask]).astype(np.int8)) == 1)) if n else 0
                left = np.frombuffer(raw, np.uint8)[~mask].tobytes() if n else raw
                text = None
                if with_text:
                    text = np.frombuffer(raw, np.uint8)[~_whole(raw, mask)].tobytes().decode() if n else raw.decode()
                out.append((i, th, len(raw), n, spans, hashlib.sha256(left).hexdigest(), text))
            for lo in range(0, len(out), 1000):
                cols = list(zip(*out[lo : lo + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string())], names=[f.split()[0] for f in FINISHED.split(", ")])

    return run


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """FINISHED for every row: what stays of a text without the bytes of strings of WIDTH bytes that
    also start in a row of a smaller key. ``kept`` (with_text only) leaves a character whole if
    any byte of it stays.

    Null text counts as empty. Rows of equal keys never take anything from each other; a null key
    counts as larger than all others. Other columns are left out. No documents: no rows.
    """
    return _repeats(docs, key, text, with_text, Workspace(docs.sparkSession))


def _repeats(docs: DataFrame, key: str, text: str, with_text: bool, work: Workspace) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.xxhash64(t).alias("th"), t.alias("text"))
    n = F.octet_length("text").cast("long")
    narrow = work.keep(src.select("id", "th", F.xxhash64(F.lit(1), "text").alias("th2"), n.alias("n"), F.when(n < WIDTH, F.sha2("text", 256)).alias("sha"), F.when(n < WIDTH, F.col("text")).alias("short")))
    # copies of a smaller document's whole text: nothing stays of them, and nobody needs them. A text that
    # a third of all rows hold is summed, and met, in SALT parts
    narrow = narrow.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    least = narrow.groupBy("th", "th2", "salt").agg(F.min("id").alias("least"), F.count("*").alias("c")).groupBy("th", "th2")
    least = least.agg(F.min("least").alias("least"), F.sum("c").alias("c"), F.collect_list("salt").alias("salts")).where("c > 1").select("th", "th2", "least", F.explode("salts").alias("salt"))
    copies = work.keep(narrow.join(least, ["th", "th2", "salt"]).where("id > least").drop("least", "salt", "th2"))
    whole = F.col("n") >= WIDTH
    empty = hashlib.sha256(b"").hexdigest()
    of_copies = copies.select(
        "id", "th", F.col("n").alias("n_bytes"), F.when(whole, F.col("n")).otherwise(0).alias("n_removed"),
        whole.cast("long").alias("n_spans"), F.when(whole, empty).otherwise(F.col("sha")).alias("kept_sha256"),
        (F.when(whole, "").otherwise(F.col("short")) if with_text else F.lit(None).cast("string")).alias("kept"),
    )
    left = src.join(copies.select("id", "th").distinct(), ["id", "th"], "left_anti")
    size = narrow.agg(F.sum("n")).first()[0] or 0
    text_path = work.write(left.select("id", "th", "text").mapInArrow(lean(blocks), BLOCK_SQL), ROW_BY_ROW)
    del left
    work.release()
    whole_text = work.read(text_path, schema=BLOCK_SQL)
    tied, _ = _step(whole_text, sampler, RANKS, tied_ranks, max(32, -(-size // RANK_RANGE)), work)
    found, _ = _step(whole_text.join(tied, "g"), sorter, PIECES, tied_suffixes, max(32, -(-size // RANGE)), work)
    done = whole_text.join(found, "g", "left").mapInArrow(lean(finish(with_text)), FINISHED)
    return done.unionAll(of_copies)


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with what repeats() leaves of each text, n_chars (if there) to match; a null text stays
    null, and a document of which nothing stays has an empty text."""
    steps, work = Workspace(docs.sparkSession), Workspace(docs.sparkSession)
    cut = _repeats(docs, key, text, True, steps).where("n_removed > 0").select("id", "th", "kept")
    cut_path = work.write(cut)
    del cut
    steps.clear()
    work.release()
    left = work.read(cut_path, schema="id bigint, th bigint, kept string").groupBy("id", "th").agg(F.first("kept").alias("cut_kept__"))
    left = left.withColumnsRenamed({"id": "cut_id__", "th": "cut_th__"})
    whole = docs.withColumns({"own_id__": F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)), "own_th__": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    joined = whole.join(left.hint("merge"), (F.col("own_id__") == F.col("cut_id__")) & (F.col("own_th__") == F.col("cut_th__")), "left")
    hit = F.col("cut_kept__").isNotNull()
    new = {text: F.when(hit, F.col("cut_kept__")).otherwise(docs[text])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("cut_kept__").cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return joined.select(*(new.get(c, docs[c]).alias(c) for c in docs.columns))


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    doc = F.when(F.col("id") != NO_KEY, F.col("id")).alias("doc_id")
    return out.select(doc, "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * WIDTH}) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(n - {WIDTH} + 1, 0))) AS p FROM h)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS least FROM w) WHERE doc_id > least),
i AS (SELECT doc_id, p, sum(CASE WHEN p <= before + {WIDTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + {WIDTH} AS b FROM i GROUP BY doc_id, run),
k AS (SELECT s.doc_id, a, b, substr(h, 2 * lag(b, 1, 0) OVER o + 1, 2 * (a - lag(b, 1, 0) OVER o)) AS left_part FROM s JOIN h USING (doc_id) WINDOW o AS (PARTITION BY s.doc_id ORDER BY a)),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(left_part, '' ORDER BY a) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN t USING (doc_id)
"""
