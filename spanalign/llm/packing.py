"""Best-fit packing with a tree of residual rounds.

Each partition of the input packs its own pieces best-fit and emits the nearly full bins. What
remains, one row per underfull bin, meets the underfull bins of neighbouring partitions as items
of the next round; what counts as nearly full loosens by each round, so that the tree stays thin.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.bpe import codec
from spanalign.llm.common import Workspace, table

CAPACITY = 2048
FAN_IN = 8
WINDOW = 400_000

ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("done", pa.bool_()), ("sequence_id", pa.int64()), ("grp", pa.int64()), ("fill", pa.int32()), ("items", pa.list_(ITEM))])
BIN_SQL = "done boolean, sequence_id bigint, grp bigint, fill int, items array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items by bin: largest first, each into the fullest bin that takes it.

    Open bins stand in a list per free space; a bit set of the free spaces in use finds the
    smallest sufficient one in constant time.
    """
    bins: list[list[int]] = []
    free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = in_use >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = free_bins[free].pop()
            if not free_bins[free]:
                in_use ^= 1 << free
        else:
            free, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        if rest := free - size:
            free_bins[rest].append(at)
            in_use |= 1 << rest
    return bins


def _bins(items: dict[str, np.ndarray], bounds: np.ndarray, members: list[list[int]], first_id: int, grp: int, slack: int, capacity: int):
    """Record batches of packed bins; item k of the round is rows bounds[k]:bounds[k + 1] of ``items``."""
    for lo in range(0, len(members), 2000):
        some = members[lo : lo + 2000]
        flat = np.fromiter((k for m in some for k in m), np.int64)
        per_bin = np.array([len(m) for m in some])
        sizes = items["total"][flat]
        ends = np.cumsum(sizes)
        last = np.cumsum(per_bin)
        fills = np.diff(np.concatenate([[0], ends[last - 1]]))
        base = ends - sizes - np.repeat(np.concatenate([[0], ends[last - 1][:-1]]), per_bin)
        n = bounds[flat + 1] - bounds[flat]
        rows = np.repeat(bounds[flat] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        cols = {c: items[c][rows] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        offset = items["offset"][rows] + np.repeat(base, n)
        null = items["null"][rows]
        struct = pa.StructArray.from_arrays([pa.array(cols["doc_id"], pa.int64(), mask=null), pa.array(cols["piece"], pa.int32()), *(pa.array(cols[c], pa.int64()) for c in ("start", "length", "ids_crc32")), pa.array(offset, pa.int64())], fields=list(ITEM))
        rows_per_bin = np.add.reduceat(n, last - per_bin)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows_per_bin)]), pa.int32()), struct)
        yield pa.RecordBatch.from_arrays([pa.array(fills >= capacity - slack), pa.array(first_id + lo + np.arange(len(some)), pa.int64()), pa.array(np.full(len(some), grp), pa.int64()), pa.array(fills, pa.int32()), lists], schema=BIN)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document's ids; only a first piece may be shorter."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)] if n else [0]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:], strict=False)]


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """All documents' pieces with their sequence and the place in it.

    A document is its ids and then ``end_id``, so an empty or null text is one token. Null keys
    and repeated rows are packed like any row; other columns are ignored. No documents: no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    end = np.array([end_id], "<u4").tobytes()
    slack = max(1, capacity // 128)

    def first(batches):
        from pyspark import TaskContext

        code, task, made = codec(tokenizer), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def flush():
            nonlocal made
            if not rows:
                return
            cols = dict(zip(("doc_id", "null", "piece", "start", "length", "ids_crc32"), map(np.array, zip(*rows, strict=True)), strict=True))
            cols |= {"offset": np.zeros(len(rows), np.int64), "total": cols["length"]}
            members = best_fit(cols["length"], capacity)
            yield from _bins(cols, np.arange(len(rows) + 1), members, (task << 32) + made, task, slack, capacity)
            made += len(members)
            rows.clear()

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc or 0, doc is None, k, *p) for k, p in enumerate(cut(code.encode(t) + end, capacity))]
            if len(rows) >= WINDOW:
                yield from flush()
        yield from flush()

    def again(round_no: int, allowed: int):
        def run(batches):
            from pyspark import TaskContext

            task, grps, parts = TaskContext.get().partitionId(), [], []
            for batch in batches:
                grps.append(batch.column("grp").to_numpy())
                parts.append(batch.column("items"))
            if not parts:
                return
            lists = pa.chunked_array(parts).combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.chunk(0)
            flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            cols = {f.name: flat.field(f.name).fill_null(0).to_numpy() for f in ITEM}
            cols["null"] = flat.field("doc_id").is_null().to_numpy(zero_copy_only=False)
            cols["total"] = np.add.reduceat(cols["length"], bounds[:-1])
            members = best_fit(cols["total"], capacity)
            yield from _bins(cols, bounds, members, (round_no << 58) + (task << 32), int(grps[0][0]), allowed, capacity)

        return run

    paths = [work.write(src.mapInArrow(first, BIN_SQL))]
    last = work.read(paths[0], schema=BIN_SQL)
    groups = (last.agg(F.max("grp")).first()[0] or 0) + 1
    rounds = 0
    while groups > 1:
        groups, rounds = -(-groups // fan_in), rounds + 1
        slack *= 4
        left = last.where(~F.col("done")).withColumn("grp", F.floor(F.col("grp") / fan_in)).repartition(groups, "grp")
        paths.append(work.write(left.mapInArrow(again(rounds, slack if groups > 1 else capacity), BIN_SQL)))
        last = work.read(paths[-1], schema=BIN_SQL)
    # the last round's bins all count, whatever their fill
    done = [work.read(p, schema=BIN_SQL).where(F.lit(k == len(paths) - 1) | F.col("done")) for k, p in enumerate(paths)]
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionAll(d)
    item = bins.select("sequence_id", F.explode("items").alias("i"))
    return item.select(F.col("i.doc_id").alias(key), "i.piece", "i.start", "i.length", "i.ids_crc32", "sequence_id", "i.offset")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
