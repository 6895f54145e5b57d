"""MinHash near-deduplication with fast similarity sketches.

A document is the set of its distinct k-word shingles. The sketch throws the shingles into T bins in
rounds: in round i < T every shingle is hashed anew to a bin with value i + u, in round T + j the bin
j takes the smallest value of all, so every coordinate fills; a coordinate of two sets agrees with the
probability of their Jaccard similarity, concentrated as for independent hashes. BANDS bands of ROWS
coordinates propose candidates (a link of similarity 0.8 is missed with probability below 1e-7), and
every link is confirmed on the full sets.

No pairs of a bucket are listed. Equal sets are one class first. Each bucket then checks its members
against one hub, the member that meets most others over all buckets, by joins salted for popular hubs.
Only buckets whose members are still in several components are compared in full, in tiles of bounded
size, so no link between different texts is lost. Components come from alternating large-star and
small-star rounds over the confirmed links, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import documents, free_memory, spread_join, text_of, written

T, ROWS = 128, 4
BANDS = T // ROWS
#: Members of a bucket that one tile holds, and links that one salted group of a hub holds, on average.
TILE, GROUP = 256, 128

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_VALUE = np.uint64((1 << 56) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _offsets(first: int, n: int) -> np.ndarray:
    return np.array([(_G * (i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(first, first + n)], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of a UTF-8 text; fewer words are one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(k, n)
    s = _mix(h[: n - k + 1] + np.uint64(k))
    for j in range(1, k):
        s = _mix(s + h[j : n - k + 1 + j])
    return np.unique(s)


def fast_sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates of a non-empty set of 64-bit hashes; t is a power of two up to 128."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    shift = np.uint64(64 - (t.bit_length() - 1))
    rounds, i = max(1, min(t, 4 * t // len(s))), 0
    while i < t and (out == np.iinfo(np.uint64).max).any():
        k = min(rounds, t - i)
        h = _mix(s[None, :] + _offsets(i, k)[:, None])
        np.minimum.at(out, (h >> shift).ravel().astype(np.intp), ((h & _VALUE) | (np.arange(i, i + k, dtype=np.uint64) << np.uint64(56))[:, None]).ravel())
        i += k
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[j] = (_mix(s + _offsets(t + int(j), 1)) & _VALUE).min() | np.uint64((t + int(j)) << 56)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    x = sketch.reshape(-1, ROWS)
    key = _offsets(1000, len(x))
    for j in range(ROWS):
        key = _mix(key + x[:, j])
    return key.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            ids, texts = (b.column(c).slice(at, 2000) for c in ("id", "text"))
            n, sig, keys, ends = [], [], [], [0]
            for i, text in zip(ids.to_pylist(), texts.to_pylist()):
                s = shingles(text, k)
                n.append(len(s))
                if len(s):
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(band_keys(fast_sketch(s)))
                else:  # no two empty sets are linked: each has a class of its own
                    sig.append(xxhash.xxh3_128_digest(f"empty {i}".encode()))
                ends.append(ends[-1] + BANDS * bool(len(s)))
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sig, pa.binary()), bands], ["id", "n", "sig", "bands"])
    _words.clear()  # the worker outlives the task
    free_memory()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text_a, text_b), the linked (a, b)."""
    hub, hub_set = None, None
    for x in batches:
        keep = []
        for b, ta, tb in zip(x.column("b").to_pylist(), x.column("text_a").to_pylist(), x.column("text_b").to_pylist()):
            if b != hub:
                hub, hub_set = b, shingles(tb, k)
            keep.append(_linked(shingles(ta, k), hub_set, percent))
        yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tile_links(k: int, percent: int):
    """Links between the rows of side 0 and side 1 of a tile (or within side 0) that are in different components."""

    def f(table: pa.Table) -> pa.Table:
        ids, comps, sides = (table.column(c).to_numpy() for c in ("id", "comp", "side"))
        sets = [shingles(t, k) for t in table.column("text").to_pylist()]
        left = np.flatnonzero(sides == 0)
        right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
        size = np.array([len(s) for s in sets])
        flat = np.concatenate([sets[i] for i in left]) if len(left) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(left)), size[left])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        a, b = [], []
        for j in right:
            lo, hi = np.searchsorted(flat, sets[j], "left"), np.searchsorted(flat, sets[j], "right")
            n = hi - lo
            hits = owner[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(n) else np.empty(0, int)
            both = np.bincount(hits, minlength=len(left))
            for i in left[(100 * both >= percent * (size[left] + size[j] - both)) & (comps[left] != comps[j])]:
                a.append(max(ids[i], ids[j]))
                b.append(min(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return f


def _round(pairs: DataFrame) -> DataFrame:
    """One large-star and one small-star step over pairs (a, b), a > b."""

    def star(n: DataFrame) -> DataFrame:
        return n.join(n.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("least")).withColumn("least", F.least("w", "least")), F.col("u") == F.col("w"))

    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    large = star(both).where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b")).distinct()
    down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
    small = star(down).select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("least").alias("b")), F.struct(F.col("u").alias("a"), F.col("least").alias("b")))).alias("p"))
    return small.select("p.*").where("a > b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(id, comp) of every vertex of pairs (a, b) but the smallest of its component, which is comp."""
    now = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    before = None
    while True:
        now = written(now, "star")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen[0] == 0 or seen == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        before, now = seen, _round(now)


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows whose id is in `ids`."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    return rows.join(ids, "id", "left_semi")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links of similarity percent / 100 or more. Empty,
    null and white-space texts are linked with nothing and kept. Rows that share an id are one vertex
    and get one answer. A row whose id is null is linked with nothing, has a null component and is kept.
    An empty table gives no rows; further columns of `docs` are not looked at.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    feats = written(rows.mapInArrow(lambda it: _sketched(it, k), "id long, n long, sig binary, bands array<long>"), "sketches")
    classes = written(feats.where("id is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    reps = written(feats.where("n > 0").select("id", "bands").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("bands").alias("key")).distinct(), "bands")
    crowded = reps.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    multi = written(reps.join(crowded, "key"), "buckets")

    weight = multi.groupBy("id").agg(F.sum("c").alias("weight"))
    hubs = multi.join(weight, "id").groupBy("key").agg((-F.max(F.struct("weight", -F.col("id"))).getField("col2")).alias("b"))
    tried = multi.join(hubs, "key").where("id != b").select(F.col("id").alias("a"), "b").distinct()
    tried = written(tried, "candidates")
    texts = written(_texts(docs, multi.select("id").distinct(), id_col, text_col), "texts")

    salts = tried.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    left = tried.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    left = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    right = salts.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("b", "text_b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    links = written(left.join(right, ["b", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirmed(it, k, percent), "a long, b long").distinct(), "links")

    first = components(links)
    members = multi.join(first, "id", "left").select("key", "id", "c", F.coalesce("comp", "id").alias("comp"))
    # three or more members in several components; of buckets with the same members, one
    by_comp = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"))
    open_ = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("m"), F.count("*").alias("comps"), F.sum("who").alias("who")).where("m > 2 and comps > 1")
    open_ = open_.groupBy("m", "who").agg(F.min(F.struct("key", "main")).alias("x")).select("x.key", "x.main.comp", F.col("x.main.n").alias("n"), "m")
    # members of the bucket's largest component are compared with the others only: those are tiles 0, 1, ..., these -1, -2, ...
    open_ = open_.select("key", F.col("comp").alias("main"), F.ceil(F.col("n") / TILE).cast("int").alias("mains"), F.ceil((F.col("m") - F.col("n")) / TILE).cast("int").alias("rests"))
    in_main = F.col("comp") == F.col("main")
    dealt = members.join(open_, "key").withColumn("mine", F.when(in_main, -1 - F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("rests"))).cast("int"))
    others = F.sequence(F.when(in_main, F.lit(0)).otherwise(-F.col("mains")), F.col("rests") - 1)
    dealt = dealt.select("key", "id", "comp", "mine", F.explode(others).alias("other"))
    tiles = dealt.select("key", "id", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    more = tiles.join(texts, "id").groupBy("key", "i", "j").applyInArrow(_tile_links(k, percent), "a long, b long").distinct()
    more = written(more, "links")
    comps = first if more.isEmpty() else components(links.union(more))

    by_class = classes.join(comps, classes.rep == comps.id, "left").select("sig", "size", F.coalesce("comp", "rep").alias("comp"))
    known = spread_join(feats.where("id is not null").select("id", "n", "sig"), written(by_class, "by_class"), "sig", "size", by="id")
    found = known.select("id", "n", F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")).alias("comp")).unionByName(feats.where("id is null").select("id", "n", F.lit(None).cast("long").alias("comp")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=2)


#: Brute force over all pairs is out of reach of SQL on whole tables; tests/llm checks the query on fixtures.
QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
