"""Exact near-duplicate vectors by dual traversal of cover trees.

Vectors of one label are dealt to the nearest centre of a net that is fitted on a bounded sample. A
vector also visits the cells that can hold a link to it: those whose border with its own cell, a
hyperplane, is no further away than the threshold. One task builds the cover trees of a cell and of
its visitors, nested levels with halving radii, and walks both together: node pairs too far apart by
their covering radii are dropped, node pairs that must be linked as a whole are counted as a whole,
and leaves are compared in double precision.

In many dimensions no border is further away than the threshold, and no node pair is dropped. So a
label of many cells is searched in SUBSPACES groups of coordinates: of two vectors within the
threshold at least one group's parts lie within the threshold over the root of SUBSPACES. Each group
has its own cells and its own trees, where both bounds bite; leaves compare whole vectors, and a pair
counts in the group where its parts are nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import Workspace, table
from spanalign.llm.components import components
from spanalign.llm.runs import runs

COSINE = 0.98
#: Vectors that the nets are fitted on.
SAMPLE = 20_000
#: Vectors of a cell in one task, and visitors to them.
BLOCK = 2048
VISITORS = 4 * BLOCK
#: Children of a node, and vectors in a leaf, of a cover tree.
CHILDREN = 16
LEAF = 128
#: A label of more cells than this is searched by groups of coordinates.
CELLS = 32
SUBSPACES = 8
#: Coordinates that a group has at least.
COORDINATES = 4
#: Parts into which equal vectors are dealt.
SALT = 64
_SLACK = 1e-9


class Node:
    __slots__ = ("centre", "radius", "lo", "hi", "children")

    def __init__(self, centre, radius, lo, hi, children):
        self.centre, self.radius, self.lo, self.hi, self.children = centre, radius, lo, hi, children


def cover_tree(x: np.ndarray) -> tuple[Node, np.ndarray]:
    """Tree over unit vectors and their order; a node holds the places lo..hi of the order.

    A level's nodes are at least the level's radius apart and hold what is nearest to them; their
    radius is then what they really cover. The next level's radius is half of it.
    """
    order = np.arange(len(x))

    def build(lo: int, hi: int, scale: float) -> Node:
        own = order[lo:hi].copy()
        pts = x[own]
        centre = pts[0]
        dist = np.sqrt(np.maximum(0.0, ((pts - centre) ** 2).sum(1)))
        radius = float(dist.max())
        if hi - lo <= LEAF or radius <= 1e-7:
            return Node(centre, radius, lo, hi, [])
        scale = min(scale, radius)
        while True:
            scale /= 2
            nearest, best, nets = np.zeros(len(pts), np.int64), dist.copy(), [0]
            while len(nets) < CHILDREN:
                far = int(best.argmax())
                if best[far] <= scale:
                    break
                d = np.sqrt(np.maximum(0.0, ((pts - pts[far]) ** 2).sum(1)))
                closer = d < best
                nearest[closer], best[closer] = len(nets), d[closer]
                nets.append(far)
            if len(nets) > 1:
                break
        children, at = [], lo
        by = np.argsort(nearest, kind="stable")
        order[lo:hi] = own[by]
        for k, n in enumerate(np.bincount(nearest, minlength=len(nets)).tolist()):
            first = np.flatnonzero(order[at : at + n] == own[nets[k]])[0]
            order[[at, at + first]] = order[[at + first, at]]
            children.append(build(at, at + n, scale))
            at += n
        return Node(centre, radius, lo, hi, children)

    return build(0, len(x), 4.0), order


def _joined(hit: np.ndarray) -> np.ndarray:
    """Smallest node, rows first and columns after them, that each node of a bipartite graph reaches."""
    rows, cols = hit.shape
    a, b = np.arange(rows), np.full(cols, rows + cols)
    while True:
        new_b = np.minimum(b, np.where(hit, a[:, None], rows + cols).min(0))
        new_a = np.minimum(a, np.where(hit, new_b[None, :], rows + cols).min(1))
        if (new_a == a).all() and (new_b == b).all():
            return np.concatenate([a, np.where(b < rows + cols, b, rows + np.arange(cols))])
        a, b = new_a, new_b


def dual(a: tuple[Node, np.ndarray], xa: np.ndarray, b: tuple[Node, np.ndarray], xb: np.ndarray, same: bool, cosine: float, wa: np.ndarray, wb: np.ndarray, sub: int = 0, of: int = 1):
    """Weights of linked partners of a's and b's rows, and edges that connect what is linked, as rows of a with those of b behind them.

    With of > 1 the trees are over the coordinates sub, sub + of, ...; only pairs that are nearest there count.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * cosine) / of)
    (ra, oa), (rb, ob) = a, b
    pa_, pb_ = xa[oa], xb[ob]
    ca, cb = np.concatenate([[0], np.cumsum(wa[oa])]), np.concatenate([[0], np.cumsum(wb[ob])])
    add_a, add_b = np.zeros(len(pa_) + 1, np.int64), np.zeros(len(pb_) + 1, np.int64)
    behind = 0 if same else len(pa_)
    edges: list[np.ndarray] = []
    stack = [(ra, rb)]
    while stack:
        p, q = stack.pop()
        d = float(np.sqrt(max(0.0, ((p.centre - q.centre) ** 2).sum())))
        if d - p.radius - q.radius > reach + _SLACK:
            continue
        rows, cols = oa[p.lo : p.hi], ob[q.lo : q.hi]
        if of == 1 and d + p.radius + q.radius < reach - _SLACK:
            # every vector of p is linked with every one of q
            add_a[p.lo] += cb[q.hi] - cb[q.lo]
            add_a[p.hi] -= cb[q.hi] - cb[q.lo]
            if not (same and p is q):
                add_b[q.lo] += ca[p.hi] - ca[p.lo]
                add_b[q.hi] -= ca[p.hi] - ca[p.lo]
            nodes = np.concatenate([rows, cols + behind])
            edges.append(np.stack([nodes, np.full(len(nodes), nodes[0])]))
            continue
        if not p.children and not q.children:
            hit = pa_[p.lo : p.hi] @ pb_[q.lo : q.hi].T >= cosine
            i, j = np.nonzero(hit)
            if of > 1 and len(i):
                for lo in range(0, len(i), 1 << 16):
                    some = slice(lo, lo + (1 << 16))
                    apart = (pa_[p.lo + i[some]] - pb_[q.lo + j[some]]) ** 2
                    hit[i[some], j[some]] = np.stack([apart[:, k::of].sum(1) for k in range(of)]).argmin(0) == sub
                i, j = np.nonzero(hit)
            if not len(i):
                continue
            w = np.bincount(i, wb[cols][j], len(rows)).astype(np.int64)
            add_a[p.lo : p.hi] += w
            add_a[p.lo + 1 : p.hi + 1] -= w
            if not (same and p is q):
                w = np.bincount(j, wa[rows][i], len(cols)).astype(np.int64)
                add_b[q.lo : q.hi] += w
                add_b[q.lo + 1 : q.hi + 1] -= w
            nodes = np.concatenate([rows, cols + behind])
            edges.append(np.stack([nodes, nodes[_joined(hit)]]))
            continue
        if same and p is q:
            kids = p.children
            stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif not q.children or p.children and p.radius >= q.radius:
            stack += [(k, q) for k in p.children]
        else:
            stack += [(p, k) for k in q.children]
    na, nb = np.empty(len(pa_), np.int64), np.empty(len(pb_), np.int64)
    na[oa], nb[ob] = np.cumsum(add_a)[:-1], np.cumsum(add_b)[:-1]
    got = np.concatenate([*edges, np.empty((2, 0), np.int64)], 1)
    return na, nb, np.unique(got[:, got[0] != got[1]], axis=1)


def _forest(edges: np.ndarray) -> np.ndarray:
    """Edges that connect the same nodes, at most one for each node."""
    up: dict[int, int] = {}

    def root(k):
        while up.setdefault(k, k) != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    for i, j in edges.T.tolist():
        x, y = root(i), root(j)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((i, j))
    return np.array(out, np.int64).reshape(-1, 2).T


MADE = "rep bigint, n bigint, other bigint"


def _compare(cosine: float):
    """(grp, sub, of, side, rep, w, unit) sorted by grp -> MADE: counts (other null) and links.

    Sides: 2 of a block with itself, else 0 and 1.
    """
    def run(batches):
        for rows in runs(batches, "grp"):
            grp = rows.column("grp").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(grp[1:] != grp[:-1]) + 1, [len(grp)]])
            side_all, rep_all, w_all, sub_all, of_all = (rows.column(c).to_numpy() for c in ("side", "rep", "w", "sub", "of"))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                side, rep, w, sub, of = side_all[lo:hi], rep_all[lo:hi], w_all[lo:hi], int(sub_all[lo]), int(of_all[lo])
                unit = rows.column("unit").slice(lo, hi - lo).combine_chunks()
                unit = unit.chunk(0) if isinstance(unit, pa.ChunkedArray) else unit
                x = unit.flatten().to_numpy().reshape(hi - lo, -1)
                left, right = side != 1, side == 1
                same = bool((side == 2).all())
                if not same and not (left.any() and right.any()):
                    continue
                xa, ra, wa = x[left], rep[left], w[left]
                xb, rb, wb = (xa, ra, wa) if same else (x[right], rep[right], w[right])
                tree_a = cover_tree(xa[:, sub::of])
                tree_b = tree_a if same else cover_tree(xb[:, sub::of])
                na, nb, links_ = dual(tree_a, xa, tree_b, xb, same, cosine, wa, wb, sub, of)
                # pairs of different nodes of one tree were counted for one side of each
                reps, n = (ra, na + nb) if same else (np.concatenate([ra, rb]), np.concatenate([na, nb]))
                some = n > 0
                a, b = reps[_forest(links_)]
                k = int(some.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([reps[some], a]), pa.int64()), pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)]), pa.int64()), pa.array(np.concatenate([np.zeros(k, np.int64), b]), pa.int64(), mask=np.arange(k + len(a)) < k)],
                    names=["rep", "n", "other"],
                )

    return run


def _net(sample: np.ndarray, parts: int) -> np.ndarray:
    """Centres, at most ``parts``, of a farthest-point net of the sample: the top of the cover tree."""
    nets = [0]
    best = ((sample - sample[0]) ** 2).sum(1)
    while len(nets) < parts:
        far = int(best.argmax())
        if best[far] <= 1e-12:
            break
        nets.append(far)
        best = np.minimum(best, ((sample - sample[far]) ** 2).sum(1))
    return sample[nets]


def _nets(sample: np.ndarray, n: int) -> list[np.ndarray]:
    """The centres of each group of coordinates for a label of n vectors."""
    cells = -(-n // BLOCK)
    if cells <= CELLS:
        return [_net(sample, cells)]
    of = max(1, min(SUBSPACES, sample.shape[1] // COORDINATES))
    # a sample in the order of hashes: any first part of it is one too
    return [np.unique(sample[:cells, k::of], axis=0) for k in range(of)]


def _dealt(x: np.ndarray, net: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, side): each row's own cell (side 0), and the earlier ones that may hold a link to it (side 1).

    The distance to the border between the own centre c and another one d is (|x - d|^2 - |x - c|^2) / 2 |c - d|.
    """
    out = []
    size = max(1, (1 << 22) // len(net))
    norms = (net * net).sum(1)
    for lo in range(0, len(x), size):
        some = x[lo : lo + size]
        dist = norms - 2 * (some @ net.T)
        own = dist.argmin(1)
        at = np.arange(len(some))
        between = np.sqrt(np.maximum(0.0, norms[own][:, None] + norms - 2 * (net[own] @ net.T)))
        near = dist - dist[at, own][:, None] <= 2 * between * reach + _SLACK
        near &= np.arange(len(net)) < own[:, None]
        i, cell = np.nonzero(near)
        out.append((np.concatenate([at, i]) + lo, np.concatenate([own, cell]), np.concatenate([np.zeros(len(at), np.int64), np.ones(len(i), np.int64)])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


ROUTED = "cls string, rep bigint, w bigint, unit array<double>, sub int, of int, cell int, side int"


def _route(nets, cosine: float):
    """(cls, rep, w, unit) -> ROUTED: every vector with its cells."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def run(batches):
        known = nets.value
        for batch in batches:
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            for c in np.unique(cls).tolist():
                here = np.flatnonzero(cls == c)
                rows = batch.take(pa.array(here))
                of_class = known.get(c)
                for sub, net in enumerate(of_class or [None]):
                    if net is None:
                        row, cell, side = np.arange(len(here)), np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
                    else:
                        x = rows.column("unit").flatten().to_numpy().reshape(len(here), -1)[:, sub :: len(of_class)]
                        row, cell, side = _dealt(x, net, reach / np.sqrt(len(of_class)) + _SLACK)
                    out = rows.take(pa.array(row))
                    more = [np.full(len(row), sub), np.full(len(row), len(of_class or [0])), cell, side]
                    yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(m, pa.int32()) for m in more)], names=["cls", "rep", "w", "unit", "sub", "of", "cell", "side"])

    return run


def _fitted(reps: DataFrame) -> dict:
    """cls: nets, of the labels that don't fit into one task, largest first; fitted on SAMPLE vectors at most."""
    sizes = {r["cls"]: r["n"] for r in reps.groupBy("cls").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).orderBy(F.desc("n")).limit(SAMPLE // 16).collect()}
    if not sizes:
        return {}
    share = min(1.0, SAMPLE / sum(sizes.values()))
    drawn = reps.where(F.col("cls").isin(list(sizes))).where(F.pmod("vh", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    drawn = drawn.select("cls", "unit", "vh").orderBy(F.pmod("vh", F.lit(1 << 30)), "vh").limit(SAMPLE).drop("vh").toArrow()
    cls = drawn.column("cls").to_numpy()
    units = drawn.column("unit").combine_chunks()
    units = units.chunk(0) if isinstance(units, pa.ChunkedArray) else units
    out = {}
    for c in np.unique(cls).tolist():
        some = units.take(pa.array(np.flatnonzero(cls == c)))
        out[c] = _nets(some.flatten().to_numpy().reshape(len(some), -1), sizes[c])
    return out


def links(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """key, n_links and component_id of every row.

    Rows with a null label and vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing; vectors of different lengths aren't compared. Equal vectors are
    compared once. A null key takes part, but names no component; a component of null keys only has a
    null one. Rows of equal keys are rows like others. Other columns are ignored. No rows: no rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark)
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    good = F.col("label").isNotNull() & F.coalesce(finite & (F.size("v") > 0), F.lit(False)) & (largest > 0)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    rows = rows.withColumn("v", F.when(good, F.transform("v", lambda x: x / largest)))
    rows = rows.withColumn("unit", F.when(F.col("v").isNotNull(), F.transform("v", lambda x: x / norm))).drop("v")
    rows = rows.withColumn("cls", F.when(F.col("unit").isNotNull(), F.concat_ws(":", F.size("unit").cast("string"), "label")))
    rows = work.keep(rows.withColumn("vh", F.xxhash64("cls", "unit")).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALT))))
    # equal vectors of a label in one row, summed in SALT parts
    some = rows.where("unit IS NOT NULL")
    same = ["vh", "cls", "unit"]
    reps = some.groupBy(*same, "salt").agg(F.min("id").alias("least"), F.count("*").alias("w")).groupBy(*same)
    reps = reps.agg(F.min("least").alias("least"), F.sum("w").alias("w"), F.collect_list("salt").alias("salts"))
    reps = work.keep(reps.withColumn("rep", F.monotonically_increasing_id()))
    nets = spark.sparkContext.broadcast(_fitted(reps))
    routed = work.keep(reps.select("cls", "rep", "w", "unit").mapInArrow(_route(nets, cosine), ROUTED))
    # a cell of more than a block meets block by block, its visitors beside it
    cell = ["cls", "sub", "cell"]
    parts = routed.groupBy(*cell).agg(F.ceil(F.count_if(F.col("side") == 0) / BLOCK).alias("pa"), F.ceil(F.count_if(F.col("side") == 1) / VISITORS).alias("pb")).where("pa > 0")
    placed = routed.join(work.keep(parts), cell).withColumn("block", F.expr("pmod(xxhash64(rep), IF(side = 0, pa, pb))"))
    own = """concat(transform(sequence(0L, pa - 1), b -> struct('own' AS kind, least(b, block) AS a, greatest(b, block) AS b, IF(b = block, 2, IF(b > block, 0, 1)) AS side)),
      IF(pb = 0, CAST(array() AS array<struct<kind: string, a: bigint, b: bigint, side: int>>), transform(sequence(0L, greatest(pb, 1L) - 1), b -> struct('visit' AS kind, block AS a, b AS b, 0 AS side))))"""
    visit = "transform(sequence(0L, pa - 1), a -> struct('visit' AS kind, a AS a, block AS b, 1 AS side))"
    met = placed.select("cls", "sub", "of", "cell", "rep", "w", "unit", F.explode(F.expr(f"IF(side = 0, {own}, {visit})")).alias("m"))
    met = met.select(F.concat_ws("/", "sub", "cell", "m.kind", "m.a", "m.b", "cls").alias("grp"), "sub", "of", F.col("m.side").alias("side"), "rep", "w", "unit")
    made = work.keep(met.repartition("grp").sortWithinPartitions("grp").mapInArrow(_compare(cosine), MADE))
    counts = made.where("other IS NULL").groupBy("rep").agg(F.sum("n").alias("n"))
    found = components(made.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), work)
    of_rep = reps.drop("unit").join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    of_rep = of_rep.withColumn("part", F.pmod("rep", F.lit(SALT)))
    names = of_rep.groupBy("component", "part").agg(F.min("least").alias("least")).groupBy("component").agg(F.min("least").alias("name"), F.collect_list("part").alias("parts"))
    names = names.select("component", "name", F.explode("parts").alias("part"))
    of_rep = of_rep.join(names, ["component", "part"]).select("rep", F.coalesce("n", F.lit(1)).alias("n"), "name")
    named = reps.join(of_rep, "rep").select(*same, F.explode("salts").alias("salt"), "n", "name")
    out = some.join(named, [*same, "salt"]).select("id", (F.col("n") - 1).alias("n_links"), F.col("name").alias("component_id"))
    alone = rows.where("unit IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(alone).withColumnRenamed("id", key)


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    out = links(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
c AS (SELECT vec_id AS node, vec_id AS comp FROM v UNION SELECT l.b, c.comp FROM c JOIN l ON c.node = l.a),
m AS (SELECT node, min(comp) AS comp FROM c GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, m.comp AS component_id, vec_id = m.comp AS kept FROM v JOIN m ON m.node = vec_id
"""
