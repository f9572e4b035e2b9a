"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Every document gets its shingle set's MinHash signature; equal sets become one class.
2. Each class is posted under its (coordinate, value) pairs. Two classes that agree in MATCHES
   coordinates must share a posting among each one's rarest K - MATCHES + 1, so only those are
   merged (prefix); longer lists are skipped and their collisions counted from the signatures.
3. Pairs with MATCHES collisions or more span clusters; within a list only as many of its pairs are
   emitted as connect it. A list of more than LIST_ROWS classes connects all of them, uncounted: a
   superset of its pairs, which the next step takes apart again.
4. Inside each cluster links are confirmed on the full sets. The search goes outwards from one
   member and leaves out members that are connected already, so a group of copies costs one pass.
   Clusters too large for one task are confirmed in blocks, against one member first and then, for
   what that leaves apart, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import Workspace, table
from spanalign.llm.components import components
from spanalign.llm.runs import runs
from spanalign.llm.shingles import mix, shingle_sets, signatures

K = 40
#: Of K coordinates, a pair at similarity 0.75 agrees in fewer with a chance of 2e-8.
MATCHES = 14
SIMILARITY = 75
#: Rows and bytes of text of a block that one task confirms.
BLOCK_ROWS = 1000
BLOCK_BYTES = 8 << 20
LIST_ROWS = 1024

#: Stands for a null key, above all keys.
NO_KEY = 1 << 62

SIGNED = "id bigint, th bigint, n bigint, size bigint, h1 bigint, h2 bigint, sig array<int>"


def sign(batches):
    """(id, th, text) -> SIGNED; texts without words have null h1, h2 and sig."""
    names = ["id", "th", "n", "size", "h1", "h2", "sig"]
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = part.column(2)
            hashes, bounds = shingle_sets(texts.to_pylist())
            n = np.diff(bounds)
            full = n > 0
            h1, h2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            sig = np.zeros((len(n), K), np.int32)
            if full.any():
                cuts = bounds[:-1][full]
                with np.errstate(over="ignore"):
                    h1[full] = np.add.reduceat(hashes, cuts).view(np.int64)
                    h2[full] = np.add.reduceat(mix(hashes ^ np.uint64(77)), cuts).view(np.int64)
                sig[full] = signatures(hashes, np.concatenate([cuts, bounds[-1:]]), K).view(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.where(full, K, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig[full].ravel()), mask=pa.array(~full))
            size = [len(t) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(size, pa.int64()), pa.array(h1, mask=~full), pa.array(h2, mask=~full), lists], names=names)


def _spanning(sig: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect the rows of ``sig`` that agree in MATCHES coordinates, directly or over others."""
    left = np.arange(len(sig))
    a: list[int] = []
    b: list[int] = []
    while len(left):
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            centre = edge.pop()
            hit = (sig[left] == sig[centre]).sum(1) >= MATCHES
            near = left[hit]
            a += [centre] * len(near)
            b += near.tolist()
            edge += near.tolist()
            left = left[~hit]
    return a, b


def collide(batches):
    """(post, cid, sig) sorted by post -> candidate edges (a, b) that span each list."""
    for run in runs(batches, "post"):
        post, cid = run.column("post").to_numpy(), run.column("cid").to_numpy()
        sig = run.column("sig").combine_chunks()
        sig = (sig.chunk(0) if isinstance(sig, pa.ChunkedArray) else sig).flatten().to_numpy().reshape(-1, K)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(post)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(post)]]))
        out_a, out_b = [], []
        for size in np.unique(sizes[sizes > 1]):
            at = starts[sizes == size]
            if size <= 6:  # all pairs of all lists of this size at once
                i, j = np.triu_indices(size, 1)
                x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                for lo in range(0, len(x), 1 << 17):
                    hit = (sig[x[lo : lo + (1 << 17)]] == sig[y[lo : lo + (1 << 17)]]).sum(1) >= MATCHES
                    out_a.append(cid[x[lo : lo + (1 << 17)][hit]])
                    out_b.append(cid[y[lo : lo + (1 << 17)][hit]])
            else:
                for s in at:
                    a, b = _spanning(sig[s : s + size])
                    out_a.append(cid[s + np.array(a, np.int64)])
                    out_b.append(cid[s + np.array(b, np.int64)])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def confirm(batches):
    """(grp, cid, text) sorted by grp -> links (a, b) that connect what is linked inside each group."""
    for run in runs(batches, "grp"):
        grp = run.column("grp").to_numpy(zero_copy_only=False)
        cid = run.column("cid").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(grp[1:] != grp[:-1]) + 1, [len(grp)]])
        lo = 0
        while lo < len(edges) - 1:
            # some groups at a time, so that their shingles stay few
            hi, size = lo + 1, 0
            while hi < len(edges) - 1 and edges[hi + 1] - edges[lo] <= BLOCK_ROWS:
                hi += 1
            first, last = edges[lo], edges[hi]
            hashes, bounds = shingle_sets(run.column("text").slice(first, last - first).to_pylist())
            out_a, out_b = [], []
            for g in range(lo, hi):
                a, b = _linked(hashes, bounds[edges[g] - first : edges[g + 1] - first + 1])
                out_a += cid[edges[g] + np.array(a, np.int64)].tolist()
                out_b += cid[edges[g] + np.array(b, np.int64)].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
            lo = hi


def _linked(hashes: np.ndarray, bounds: np.ndarray) -> tuple[list[int], list[int]]:
    sizes = np.diff(bounds)
    left = np.arange(len(sizes))
    a: list[int] = []
    b: list[int] = []
    while len(left):
        edge, left = [int(left[0])], left[1:]
        while edge and len(left):
            centre = edge.pop()
            mine = hashes[bounds[centre] : bounds[centre + 1]]
            fits = (100 * np.minimum(sizes[left], len(mine)) >= SIMILARITY * np.maximum(sizes[left], len(mine)))
            some = left[fits]
            if not len(some):
                continue
            flat = np.concatenate([hashes[bounds[k] : bounds[k + 1]] for k in some.tolist()])
            place = np.searchsorted(mine, flat)
            place[place == len(mine)] = 0
            common = np.add.reduceat((mine[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            near = some[100 * common >= SIMILARITY * (sizes[some] + len(mine) - common)]
            a += [centre] * len(near)
            b += near.tolist()
            edge += near.tolist()
            left = left[~np.isin(left, near)]
    return a, b


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every row.

    Null and wordless texts have no shingles and are components of their own. Rows with equal sets
    are linked, repeated rows included; a null key takes part but names no component, so one that
    is linked with null keys only has null. Other columns are left out. No documents: no rows.
    """
    out = _groups(docs, key, text, Workspace(docs.sparkSession))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id")


def _groups(docs: DataFrame, key: str, text: str, work: Workspace) -> DataFrame:
    """id, th (hash of the text), n_shingles and component_id of every row."""
    src = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    signed = work.keep(src.mapInArrow(sign, SIGNED))

    # one class for each distinct set; a class of null keys only gets a number above all keys
    own = F.coalesce(F.min("id"), F.expr(f"{NO_KEY} + shiftrightunsigned(h1, 2)"))
    row = F.min(F.struct(F.coalesce("id", F.lit(NO_KEY)).alias("id"), "th"))
    classes = signed.where("n > 0").groupBy("h1", "h2").agg(own.alias("cid"), row.alias("row"), F.min("sig").alias("sig"), F.max("size").alias("size"))
    classes = work.keep(classes)

    links = _confirmed(src, signed, _clusters(classes, work), work)
    found = components(links, work)
    of_class = classes.select("h1", "h2", "cid").join(found, F.col("cid") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "cid").alias("component"))
    out = signed.select("id", "th", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    real = F.when(F.col("component") < NO_KEY, F.col("component"))
    return out.select("id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, real).otherwise(F.col("id")).alias("component_id"))


def _clusters(classes: DataFrame, work: Workspace) -> DataFrame:
    """(cid, row, cluster, blocks, block) of the classes that candidate pairs connect to others."""
    post = F.explode(F.transform("sig", lambda v, j: j.cast("long") * F.lit(1 << 32) + (v.cast("long") + F.lit(1 << 31))))
    posts_path = work.write(classes.select("cid", post.alias("post")))
    posts = work.read(posts_path, schema="cid bigint, post bigint")
    lists = posts.groupBy("post").agg(F.count("*").alias("len"), F.min("cid").alias("head")).where("len > 1")
    listed = posts.join(lists, "post").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("len", "post", "head"))).alias("p"))
    # K - size(p) lists hold this class alone: they are the rarest and fill the front of its prefix
    prefix = listed.where(F.size("p") >= MATCHES).select("cid", F.explode(F.expr(f"slice(p, 1, size(p) - {MATCHES} + 1)")).alias("x")).select("cid", "x.*")
    prefix_path = work.write(prefix)
    prefix = work.read(prefix_path, schema="cid bigint, len bigint, post bigint, head bigint")
    work.drop(posts_path)
    short = prefix.where(F.col("len") <= LIST_ROWS).join(classes.select("cid", "sig"), "cid").select("post", "cid", "sig")
    pairs = short.repartition("post").sortWithinPartitions("post").mapInArrow(collide, "a bigint, b bigint")
    # a longer list connects all its members; what that joins too much, confirming takes apart
    long = prefix.where((F.col("len") > LIST_ROWS) & (F.col("cid") != F.col("head"))).select(F.col("cid").alias("a"), F.col("head").alias("b"))
    edges_path = work.write(pairs.unionAll(long).distinct())
    work.drop(prefix_path)
    hung = components(work.read(edges_path, schema="a bigint, b bigint"), work)
    clusters = work.keep(hung.unionAll(hung.select(F.col("component").alias("node"), "component").distinct()))
    members = clusters.join(classes.select(F.col("cid").alias("node"), "row", "size"), "node")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    return work.keep(members.join(sizes, "component").select(F.col("node").alias("cid"), "row", F.col("component").alias("cluster"), "blocks", F.expr("pmod(xxhash64(node), blocks)").alias("block")))


def _confirmed(src: DataFrame, signed: DataFrame, members: DataFrame, work: Workspace) -> DataFrame:
    """(a, b): links on full sets that connect what is linked in each cluster."""
    wanted = members.select("cid", "cluster", "blocks", "block", F.col("row.id").alias("wanted_id"), F.col("row.th").alias("wanted_th"))
    texts = src.withColumn("id", F.coalesce("id", F.lit(NO_KEY))).join(wanted.hint("merge"), (F.col("id") == F.col("wanted_id")) & (F.col("th") == F.col("wanted_th")))
    texts = texts.select("cid", "cluster", "blocks", "block", "text")
    if not signed.groupBy("id", "th").count().where("count > 1").isEmpty():
        texts = texts.groupBy("cid", "cluster", "blocks", "block").agg(F.first("text").alias("text"))  # repeated rows
    texts = work.keep(texts)

    def links(rows: DataFrame) -> DataFrame:
        rows = rows.select("grp", "cid", "text").repartition("grp").sortWithinPartitions("grp")
        return work.keep(rows.mapInArrow(confirm, "a bigint, b bigint").distinct())

    block = F.xxhash64("cluster", "block").alias("grp")
    heads = texts.where("blocks > 1 AND cid = cluster").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    found = links(texts.unionAll(heads).select(block, "cid", "text"))
    if members.where("blocks > 1").isEmpty():
        return found
    # what the first member's links leave apart in a large cluster is held against all its blocks
    hung = components(found, work)
    top = members.where("blocks > 1").select("cid", "cluster").join(hung, F.col("cid") == F.col("node"), "left").select("cid", "cluster", F.coalesce("component", "cid").alias("component"))
    # a cluster's number is its least member, so the component of that member has the same number
    apart = work.keep(top.where(F.col("component") != F.col("cluster")).select("cid", "cluster"))
    parts = apart.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    big = texts.where("blocks > 1").join(parts, "cluster")
    part = F.expr("pmod(xxhash64(cid, 1), parts)")
    against = big.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    rest = big.join(apart.select("cid"), "cid", "left_semi").withColumn("part", part).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    grp = F.xxhash64("cluster", "part", "block").alias("grp")
    cross = links(against.select(grp, "cid", "text").unionAll(rest.select(grp, "cid", "text")))
    return found.unionAll(cross)


def first_of_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that groups() links to a smaller key.

    Of rows that repeat a key within a component one stays, any of them as their words are alike;
    rows of null keys that are linked with null keys only stay.
    """
    work = Workspace(docs.sparkSession)
    steps = Workspace(docs.sparkSession)
    found = work.keep(_groups(docs, key, text, steps))
    steps.clear()
    dropped = F.col("id").isNull() & F.col("component_id").isNotNull() | (F.col("id") != F.col("component_id"))
    gone = found.where(dropped).select(F.col("id").alias("gone_id__"), F.col("th").alias("gone_th__")).distinct()
    left = docs.join(gone.hint("merge"), docs[key].eqNullSafe(F.col("gone_id__")) & (F.xxhash64(docs[text]) == F.col("gone_th__")), "left_anti")
    twice = found.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias("twice_id__"))
    if twice.isEmpty():
        return left
    again = left.join(twice, left[key] == F.col("twice_id__"), "left_semi").dropDuplicates([key])
    return left.join(twice, left[key] == F.col("twice_id__"), "left_anti").unionByName(again)


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {SIMILARITY} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS comp FROM documents UNION SELECT e.b, c.comp FROM c JOIN e ON c.node = e.a),
m AS (SELECT node, min(comp) AS comp FROM c GROUP BY node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.comp AS component_id, doc_id = m.comp AS kept FROM documents JOIN m ON m.node = doc_id LEFT JOIN n USING (doc_id)
"""
