"""Near-duplicate embeddings: exact threshold pairs of cosines by dual traversal of cover trees.

Equal vectors are one class first. Between unit vectors a cosine of c is a distance of sqrt(2 - 2c), so
the links are the pairs within one distance. The tree has an upper part that Spark splits and lower
parts that tasks build:

Upper part: a node of more than BLOCK vectors is split. One vector of each hash slot of the node becomes
the centre of a child, every vector goes to the nearest centre (ties are dealt by hash, so equal
directions split too), and the child's covering radius is its farthest vector's distance. Node pairs
are then followed from the roots down: a pair whose centres are farther apart than both radii and the
threshold has no link and goes; the others become the pairs of their children.

Lower part: in a block, levels of centres with radii 1, 1/2, 1/4, ... are nested: a level's centres stay
centres of the next, no two are nearer than its radius, and every vector has a centre within it. Two
blocks are compared level by level: node pairs beyond reach go, node pairs of which all vectors must be
linked count as a whole, the others are followed; what is left at the last level is compared vector by
vector, in double precision where single doesn't decide. What a block pair leaves are counts by vector
and an edge for each join of two of the blocks' components, not its links.

Blocks are written once, a folder each. Of a pair of blocks only the names are shuffled: its task reads
the blocks from the shared folder, so that the disk grows with the vectors, not with the block pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import free_memory, shared_path, spread_join, written
from tapeloom.llm.near_dedup import components
from tapeloom.llm.warc import filesystem

#: Vectors of one block at most, and of one chunk of a product.
BLOCK, CHUNK = 4096, 512
#: Blocks of one side of a task's pairs, at most, and bytes of vectors that a task keeps.
SIDE, KEPT = 8, 128 << 20
#: Children of a split node, at most, and vectors of a node that a task deals out to them, about.
FANOUT, SHARE = 64, 32_768
#: What single precision may be wrong by in a squared distance; what a stored radius is rounded up by.
SLACK, ROUND_UP = 1e-5, 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled first, so that no square runs over or under."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _usable(v) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(np.any(v))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, d, sig, vec): vec as bytes of doubles, d its length, sig its digest; null where a row links with nothing."""
    for b in batches:
        sig, vec, dims = [], [], []
        for v in b.column("v").to_pylist():
            x = np.array([np.nan if c is None else c for c in v], np.float64) + 0.0 if v is not None else None  # -0.0 is 0.0
            raw = x.tobytes() if _usable(x) else None
            vec.append(raw)
            sig.append(raw and hashlib.blake2b(raw, digest_size=16).digest())
            dims.append(len(x) if raw else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(dims, pa.int32()), pa.array(sig, pa.binary()), pa.array(vec, pa.binary())], ["id", "d", "sig", "vec"])
    free_memory()


def _stack(column, width: int) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width))


def _children(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """A share of a node's vectors and its children (slot, centre): each vector's child, and how far from its centre it is."""
    width = len(rows.column("vec")[0].as_py()) // 8 if rows.num_rows else 0
    child, far = [], []
    if rows.num_rows:
        x, c, slots = _stack(rows.column("vec"), width), _stack(centres.column("centre"), width), centres.column("slot").to_pylist()
        node = rows.column("node")[0].as_py()
        for at in range(0, len(x), CHUNK):
            dist = np.stack([np.sqrt(((x[at : at + CHUNK] - v) ** 2).sum(axis=1)) for v in c], axis=1)
            near = dist <= dist.min(axis=1, keepdims=True) + 1e-12
            for row, ties, sig in zip(dist, near, rows.column("sig").slice(at, CHUNK).to_pylist()):
                some = np.flatnonzero(ties)
                best = some[int.from_bytes(hashlib.blake2b(sig + node.encode(), digest_size=4).digest()) % len(some)] if len(some) > 1 else some[0]
                child.append(f"{node}.{slots[best]}")
                far.append(float(row[best]) + ROUND_UP)
    free_memory()
    return pa.table({"node": pa.array(child, pa.string()), "parent": rows.column("node")} | {c: rows.column(c) for c in ("sig", "rep", "w", "vec")} | {"far": pa.array(far, pa.float64())})


def upper(classes: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """The blocks' vectors (node, sig, rep, w, vec), the nodes (node, parent, centre, radius, depth), and the greatest depth."""
    now = written(classes.select(F.col("d").cast("string").alias("node"), "sig", "rep", "w", "vec"), "tree")
    roots = now.groupBy("node").agg(F.min_by("vec", "sig").alias("centre"))
    nodes = written(roots.select("node", F.lit(None).cast("string").alias("parent"), "centre", F.lit(2.0 + ROUND_UP).alias("radius"), F.lit(0).alias("depth")), "nodes")
    blocks, depth = None, 0
    while True:
        sizes = now.groupBy("node").agg(F.count("*").alias("rows"))
        large = written(sizes.where(F.col("rows") > block).withColumn("slots", F.least(F.lit(FANOUT), F.ceil(F.col("rows") * 2 / block)).cast("int")), "large")
        rest = now.join(large.select("node"), "node", "left_anti")
        blocks = rest if blocks is None else blocks.unionByName(rest)
        if large.isEmpty():
            return written(blocks, "blocks"), nodes, depth
        depth += 1
        slot = F.pmod(F.xxhash64("sig", F.lit(depth)), F.col("slots")).cast("int")
        inner = now.join(large, "node")
        centres = written(inner.groupBy("node", slot.alias("slot")).agg(F.min_by("vec", F.xxhash64("sig")).alias("centre")), "centres")
        shares = -(-large.agg(F.max("rows")).first()[0] // SHARE)  # of each node, so that no task gets more than about SHARE vectors of one
        left = inner.select("node", "sig", "rep", "w", "vec", F.pmod(F.xxhash64("sig", F.lit("share")), F.lit(shares)).cast("int").alias("share"))
        right = centres.select("node", "slot", "centre", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
        split = left.groupBy("node", "share").cogroup(right.groupBy("node", "share")).applyInArrow(_children, "node string, parent string, sig binary, rep long, w long, vec binary, far double")
        split = written(split, "tree")
        child = centres.select(F.concat_ws(".", "node", F.col("slot").cast("string")).alias("node"), "centre")
        radius = split.groupBy("node", "parent").agg(F.max("far").alias("radius"))
        nodes = written(nodes.unionByName(radius.join(child, "node").select("node", "parent", "centre", "radius", F.lit(depth).alias("depth"))), "nodes")
        now = split.select("node", "sig", "rep", "w", "vec")


def _within(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """Of node pairs (a, b, centre_a, radius_a, ...), those that can hold a link."""
    for b in batches:
        keep = []
        for x, y, r, s in zip(*(b.column(c).to_pylist() for c in ("centre_a", "centre_b", "radius_a", "radius_b"))):
            u, v = unit(np.frombuffer(x, np.float64)[None]), unit(np.frombuffer(y, np.float64)[None])
            keep.append(float(np.sqrt(((u - v) ** 2).sum())) <= r + s + reach + ROUND_UP)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def block_pairs(nodes: DataFrame, depth: int, reach: float) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks that may hold links."""
    now = nodes.where("parent IS NULL").select(F.col("node").alias("a"), F.col("node").alias("b"))
    inner = nodes.select(F.col("parent").alias("of")).where("of IS NOT NULL").distinct()
    for d in range(1, depth + 1):
        # a node of the level above goes on as its children, a block as itself
        own = nodes.where(F.col("depth") < d).join(inner.withColumnRenamed("of", "node"), "node", "left_anti").select("node", F.col("node").alias("of"), "centre", "radius")
        below = own.unionByName(nodes.where(F.col("depth") == d).select("node", F.col("parent").alias("of"), "centre", "radius"))
        left, right = (below.select(F.col("of").alias(f"of_{s}"), F.col("node").alias(s), F.col("centre").alias(f"centre_{s}"), F.col("radius").alias(f"radius_{s}")) for s in ("x", "y"))
        met = now.join(left, now.a == left.of_x).join(right, F.col("b") == right.of_y).where("a <> b OR x <= y")
        low = F.col("x") <= F.col("y")
        turned = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *(F.when(low, F.col(f"{c}_{p}")).otherwise(F.col(f"{c}_{q}")).alias(f"{c}_{s}") for c in ("centre", "radius") for s, p, q in (("a", "x", "y"), ("b", "y", "x"))))
        now = written(turned.mapInArrow(partial(_within, reach=reach), "a string, b string"), "pairs")
    return now


class Cover:
    """Nested levels of centres over the unit vectors of a block.

    centres[l]: rows that are centres of level l; up[l]: by row the level-l centre above it; radius[l]: by
    row that is a centre of level l, the distance of the farthest row below it. The last level has all rows.
    """

    def __init__(self, x: np.ndarray, up: list[np.ndarray], radius: list[np.ndarray]) -> None:
        self.x, self.single, self.up, self.radius = x, x.astype(np.float32), up, radius
        self.centres = [np.unique(u) for u in up]


def cover(x: np.ndarray, levels: int) -> Cover:
    n, single = len(x), x.astype(np.float32)
    centres, near = np.array([0]), [np.zeros(n, np.int64)]
    for depth in range(1, levels):
        near.append(_net(single, centres, 2.0 ** (1 - depth)))
        centres = np.unique(near[-1])
    up = [np.arange(n)]
    for mine in reversed(near):
        up.insert(0, mine[up[0]])
    radius = []
    for above in up[:-1]:
        far = np.zeros(n)
        np.maximum.at(far, above, np.sqrt(((x - x[above]) ** 2).sum(axis=1)) + ROUND_UP)
        radius.append(far)
    return Cover(x, up, [*radius, np.zeros(n)])


def _net(x: np.ndarray, start: np.ndarray, r: float) -> np.ndarray:
    """By row a centre within r: the rows `start`, and others that are farther than r from those before them. A centre is its own."""
    n, least = len(x), 1 - r * r / 2
    near, most = np.full(n, -1), np.full(n, -np.inf)
    for at in range(0, len(start), CHUNK):
        part = start[at : at + CHUNK]
        s = x @ x[part].T
        best = s.argmax(axis=1)
        value = s[np.arange(n), best]
        hit = (value >= least) & (value > most)
        near[hit], most[hit] = part[best[hit]], value[hit]
    near[start] = start
    while (open_ := np.flatnonzero(near < 0)[:CHUNK]).size:
        s = x[open_] @ x.T
        for i, row in zip(open_, s):
            if near[i] < 0:
                near[(near < 0) & (row >= least)] = i
                near[i] = i
    return near


class Joined:
    """Components of n things: the smallest member stands for each."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]


def links(a: Cover, b: Cover, wa: np.ndarray, wb: np.ndarray, joined: Joined, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """How much weight of b each row of a is linked with, and the other way round; joins the rows that are
    linked: those of a have their own numbers, those of b follow. a and b may be one; then its rows have
    one number each, links with themselves count, and both results are the same."""
    reach, same = float(np.sqrt(2 - 2 * cosine)), a is b
    shift = 0 if same else len(a.x)
    count = (np.zeros(len(a.x)), np.zeros(len(b.x)))
    alive, at_a, at_b = np.ones((1, 1), bool), np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    for depth in range(len(a.up)):
        # at_a, at_b: by row of a block, where the node above it stands in `alive`; -1 where that is followed no more
        left, right = (c.centres[depth][at[c.centres[depth]] >= 0] for c, at in ((a, at_a), (b, at_b)))
        if not len(left) or not len(right):
            break
        ra, rb = a.radius[depth][left].astype(np.float32), b.radius[depth][right].astype(np.float32)
        below_a, below_b = np.bincount(a.up[depth], wa, len(a.x))[left], np.bincount(b.up[depth], wb, len(b.x))[right]
        all_of = (np.zeros(len(left)), np.zeros(len(right)))
        y, over_b = np.ascontiguousarray(b.single[right].T), at_b[right]
        go = np.empty((len(left), len(right)), bool)
        for at in range(0, len(left), CHUNK):
            part = slice(at, at + CHUNK)
            square, r = 2 - 2 * (a.single[left[part]] @ y), ra[part, None] + rb[None, :]
            m = square <= (r + np.float32(reach)) ** 2 + np.float32(SLACK)
            m &= alive[at_a[left[part]]][:, over_b]
            whole = m & (square <= np.maximum(np.float32(reach) - r, 0) ** 2 - np.float32(SLACK))
            if depth == len(a.up) - 1:  # what single precision leaves open
                i, j = np.nonzero(m & ~whole)
                for k in range(0, len(i), 65536):
                    p, q = i[k : k + 65536], j[k : k + 65536]
                    whole[p, q] = np.einsum("ij,ij->i", a.x[left[part][p]], b.x[right[q]]) >= cosine
            if whole.any():
                w = whole.astype(np.float64)
                all_of[0][part] += w @ below_b
                all_of[1][:] += below_a[part] @ w
                p, q = left[part], right + shift
                while True:
                    new = whole & (joined.of[p][:, None] != joined.of[q][None, :])
                    some = np.flatnonzero(new.any(axis=1))
                    if not some.size:
                        break
                    joined.join(p[some], q[new[some].argmax(axis=1)])
            go[part] = m & ~whole
        for side, (c, nodes, first) in enumerate(((a, left, 0), (b, right, shift))):
            given = np.zeros(len(c.x))
            given[nodes] = all_of[side]
            count[side][:] += given[c.up[depth]]
            rows = np.flatnonzero(given[c.up[depth]] > 0)  # linked with the same rows, so joined
            joined.join(rows + first, c.up[depth][rows] + first)
        rows, cols = np.flatnonzero(go.any(axis=1)), np.flatnonzero(go.any(axis=0))
        alive = go[np.ix_(rows, cols)]
        for c, nodes, kept, at in ((a, left, rows, at_a), (b, right, cols, at_b)):
            place = np.full(len(c.x), -1)
            place[nodes[kept]] = np.arange(len(kept))
            at[:] = place[c.up[depth]]
    return tuple(np.rint(c).astype(np.int64) for c in count)


def _levels(cosine: float) -> int:
    """The first level whose radius is under half of the reach, and one for the vectors themselves."""
    return next((d for d in range(1, 9) if 2.0 ** (1 - d) <= np.sqrt(2 - 2 * cosine) / 2), 8) + 1


def _built(table: pa.Table, cosine: float) -> pa.Table:
    """A block with its tree, its own links and its own components."""
    width = len(table.column("vec")[0].as_py()) // 8
    x, w = _stack(table.column("vec"), width), table.column("w").to_numpy()
    tree, joined = cover(x, _levels(cosine)), Joined(len(x))
    count, _ = links(tree, tree, w, w, joined, cosine)
    rep = table.column("rep").to_numpy()
    out = pa.table({
        "node": table.column("node"), "sig": table.column("sig"), "rep": rep, "w": w, "vec": table.column("vec"), "pos": np.arange(len(x)), "own": joined.of,
        "up": pa.array(list(np.stack(tree.up, axis=1).astype(np.int32)), pa.list_(pa.int32())), "radius": pa.array(list(np.stack(tree.radius, axis=1)), pa.list_(pa.float64())), "count": count, "comp": rep[joined.of],
    })
    free_memory()
    return out


class Block:
    """A written block, as pairs of blocks are compared: its tree, weights, own components and keys."""

    def __init__(self, t: pa.Table) -> None:
        t = t.sort_by("pos")
        up, radius = (np.array(t.column(c).to_pylist()) for c in ("up", "radius"))
        self.tree = Cover(_stack(t.column("vec"), len(t.column("vec")[0].as_py()) // 8), list(up.T), list(radius.T))
        self.w, self.own, self.rep = (t.column(c).to_numpy() for c in ("w", "own", "rep"))
        self.sig = t.column("sig").combine_chunks().cast(pa.binary())
        self.size = self.tree.x.nbytes + self.tree.single.nbytes


def _blocks(path: str) -> Callable[[str], Block]:
    """Reads blocks from their folders under `path`; those read last are kept, up to KEPT bytes of vectors."""
    fs, root = filesystem(path)
    kept: OrderedDict[str, Block] = OrderedDict()

    def read(node: str) -> Block:
        if node not in kept:
            files = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{root}/node={node}")) if x.base_name.endswith(".parquet")]
            parts = []
            for f in files:
                with fs.open_input_file(f) as opened:
                    parts.append(pq.ParquetFile(opened).read(["sig", "rep", "w", "vec", "pos", "own", "up", "radius"]))
            kept[node] = Block(pa.concat_tables(parts))
        kept.move_to_end(node)
        while len(kept) > 2 and sum(x.size for x in kept.values()) > KEPT:
            kept.popitem(last=False)
        return kept[node]

    return read


def _compared(a: Block, b: Block, cosine: float) -> pa.RecordBatch:
    """Two blocks: counts by vector, and edges between components of their own."""
    cut = len(a.own)
    own = np.concatenate((a.own, b.own + cut))
    joined = Joined(len(own))
    joined.join(np.arange(len(own)), own)
    before = joined.of.copy()
    counts = np.concatenate(links(a.tree, b.tree, a.w, b.w, joined, cosine))
    some, moved = np.flatnonzero(counts), np.flatnonzero((before != joined.of) & (before == np.arange(len(own))))
    rep = np.concatenate((a.rep, b.rep))
    n, m = len(some), len(moved)
    return pa.RecordBatch.from_pydict({
        "sig": pa.concat_arrays([pa.concat_arrays([a.sig, b.sig]).take(pa.array(some)), pa.nulls(m, pa.binary())]), "count": pa.array(np.concatenate((counts[some], np.zeros(m, np.int64)))),
        "a": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rep[moved], pa.int64())]), "b": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rep[joined.of[moved]], pa.int64())]),
    })


def _tiles(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) in an order in which blocks come again soon: neighbouring blocks are a side, a pair of sides is one task's."""
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    side = max(1, min(SIDE, nodes.count() // math.ceil(2 * tasks**0.5)))
    placed = nodes.select("node", F.floor((F.row_number().over(Window.orderBy("node")) - 1) / side).alias("side"))  # a row a block
    left, right = (placed.select(F.col("node").alias(s), F.col("side").alias(f"side_{s}")) for s in "ab")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.least("side_a", "side_b").alias("first"), F.greatest("side_a", "side_b").alias("second"))
    return met.repartition(tasks, "first", "second").sortWithinPartitions("first", "second", "a", "b").select("a", "b")


def near_vectors(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per row: `id_col`, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite entries, link with nothing, nor do
    rows whose id is null (component_id is null then). Vectors of different lengths aren't linked. n_links
    counts rows, so equal vectors are links of each other; rows that share an id are answered each by its
    own vector, and their vectors have one vertex if it is the smallest id of both. An empty table gives no
    rows. Further columns aren't looked at.
    """
    rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("v"))
    feats = written(rows.mapInArrow(_keyed, "id long, d int, sig binary, vec binary"), "vectors")
    usable = F.col("sig").isNotNull() & F.col("id").isNotNull()
    classes = feats.where(usable).groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("d").alias("d"), F.first("vec").alias("vec"))

    def build(table: pa.Table) -> pa.Table:
        return _built(table, cosine)

    blocks, nodes, depth = upper(classes, block)
    built = "node string, sig binary, rep long, w long, vec binary, pos long, own long, up array<int>, radius array<double>, count long, comp long"
    path = shared_path(df.sparkSession, "trees")
    blocks.groupBy("node").applyInArrow(build, built).write.partitionBy("node").parquet(path)
    trees = df.sparkSession.read.schema(built).parquet(path)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _blocks(path)
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if (out := _compared(read(a), read(b), cosine)).num_rows:
                    yield out
        free_memory()

    pairs = block_pairs(nodes, depth, float(np.sqrt(2 - 2 * cosine))).where("a <> b")
    more = written(_tiles(pairs, trees.select("node").distinct()).mapInArrow(compare, "sig binary, count long, a long, b long"), "links")
    edges = trees.select(F.col("rep").alias("a"), F.col("comp").alias("b")).unionByName(more.where("a IS NOT NULL").select("a", "b")).where("a <> b")
    comps = components(edges)
    counts = trees.select("sig", "rep", "w", "count").unionByName(more.where("sig IS NOT NULL").select("sig", "count"), allowMissingColumns=True).groupBy("sig").agg(F.sum("count").alias("links"), F.max("rep").alias("rep"), F.max("w").alias("w"))
    by_class = written(counts.join(comps, counts.rep == comps.id, "left").select("sig", "w", "links", F.coalesce("comp", "rep").alias("comp")), "by_class")
    linked = spread_join(feats.where(usable).select("id", "sig"), by_class, "sig", "w", by="id").select("id", (F.col("links") - 1).alias("n_links"), "comp")
    alone = feats.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("comp"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: SQL compares all pairs, which is out of reach on whole tables; tests/llm holds the query against numpy.
QUERIES = {"op11_embedding_near_dedup": op11_embedding_near_dedup}
ORACLE_SQL: dict[str, str] = {}
