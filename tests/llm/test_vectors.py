"""Embedding near-dedup, spelling variants and whitening against brute force, with awkward rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import embedding_dedup as ed
from tapeloom.llm import spelling, whitening

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, id long, v double, node string, d string, w long, k string"


def table(spark, rows, kind="float"):
    """Rows (id, vector), with further columns whose names the operators use."""
    return spark.createDataFrame([(i, v, None, 1, 2.0, "n", "d", 3, "k") for i, v in rows], VECTORS.replace("<float>", f"<{kind}>")).repartition(3)


def brute(rows, cosine=0.9):
    """By row: (id, n_links, component_id, kept)."""
    vec = [None if v is None or i is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v) else np.array(v, np.float64) / max(map(abs, v)) for i, v in rows]
    vec = [None if v is None else v / np.linalg.norm(v) for v in vec]
    n = len(rows)
    near = [[j for j in range(n) if j != i and vec[i] is not None and vec[j] is not None and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] >= cosine] for i in range(n)]
    comp = [i for i, _ in rows]
    while True:
        new = [min([comp[i], *(comp[j] for j in near[i])]) if comp[i] is not None else None for i in range(n)]
        if new == comp:
            break
        comp = new
    return sorted(((i, len(near[k]), comp[k], i is None or comp[k] == i) for k, (i, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def cloud(seed, n, d=8):
    """Clusters, chains just within and just without reach, exact copies, scaled copies, and noise."""
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(n, d)))
    for c in rng.normal(size=(4, d)):
        rows += [c + 0.1 * rng.normal(size=d) for _ in range(n // 8)]
    turn = math.acos(0.9)
    for step in (turn * 0.999, turn * 1.001):
        rows += [np.array([math.cos(k * step), math.sin(k * step)] + [0.0] * (d - 2)) for k in range(8)]
    rows += [rows[0], rows[0] * 3, rows[1], rows[n], rows[n], rows[n] / 7]
    return [list(map(float, v.astype(np.float32))) for v in rows]


@pytest.mark.parametrize("block", [4096, 60, 7])
def test_links_match_brute_force(spark, block):
    vectors = cloud(block, 120)
    rows = list(zip(np.random.default_rng(1).permutation(len(vectors)).tolist(), vectors))
    assert found(ed.near_vectors(table(spark, rows), block=block)) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [-0.0, 1.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0]), (13, [5.0]), (14, [-1.0, 0.0])]
    assert found(ed.near_vectors(table(spark, rows))) == brute(rows)
    wide = [(1, [1e300, 0.0]), (2, [1e-300, 0.0]), (3, [0.0, 5e-324]), (4, [1e300, 1e300])]
    assert found(ed.near_vectors(table(spark, wide, "double"))) == brute(wide)
    assert found(ed.near_vectors(table(spark, rows).limit(0))) == []


def test_one_direction_many_times(spark):
    """Scaled copies of one direction can't be told apart by distance, but split."""
    rows = [(i, [float(i + 1), 2.0 * (i + 1), 0.5 * (i + 1)]) for i in range(300)]
    got = found(ed.near_vectors(table(spark, rows), block=20))
    assert all(r[1:3] == (299, 0) for r in got) and len(got) == 300


@pytest.mark.parametrize("cosine", [-0.2, 0.5, 0.99, 1.0])
def test_other_thresholds(spark, cosine):
    rng = np.random.default_rng(4)
    rows = list(enumerate([list(map(float, v)) for v in rng.normal(size=(90, 4)).astype(np.float32)]))
    rows += [(100, rows[0][1]), (101, rows[0][1])]
    if cosine == 1.0:  # equal vectors are links, whatever their product rounds to
        got = {r[0]: r[1] for r in found(ed.near_vectors(table(spark, rows), cosine=1 - 1e-12, block=16))}
        assert got[0] == got[100] == got[101] == 2 and sum(got.values()) == 6
    else:
        assert found(ed.near_vectors(table(spark, rows), cosine=cosine, block=16)) == brute(rows, cosine)


def test_cover_levels():
    x = ed.unit(np.array(cloud(3, 100)))
    tree = ed.cover(x, 5)
    for depth in range(5):
        c = tree.centres[depth]
        assert set(c) <= set(tree.centres[depth + 1])
        if 0 < depth:
            gaps = np.sqrt(np.maximum(0, 2 - 2 * x[c] @ x[c].T)) + 9 * np.eye(len(c))
            assert gaps.min() > 2.0 ** (1 - depth) - 1e-3
            assert (np.sqrt(((x[tree.centres[depth + 1]] - x[tree.up[depth][tree.centres[depth + 1]]]) ** 2).sum(axis=1)) < 2.0 ** (1 - depth) + 1e-3).all()
        assert (np.sqrt(((x - x[tree.up[depth]]) ** 2).sum(axis=1)) <= tree.radius[depth][tree.up[depth]]).all()


# spelling variants
DOCS = "doc_id long, text string, word string, n long, size int, key string, run string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "k", "r") for i, t in rows], DOCS).repartition(3)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    import re

    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) if xs else None for w, xs in near.items()}
    form = {w: x if x is not None and n[x] >= 2 * n[w] else None for w, x in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n)


def variants(df, **more):
    return sorted(tuple(r) for r in spelling.variants(df, **more).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_variants_match_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abé"), int(rng.integers(5, 9)))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abaaa", "ÿÿÿÿÿ", "ÀÀÀÀÀ", "àààààà", "STRASSE", "strasse", "straße", "ab" * 3000, "ab" * 3000 + "a"]
    counts = rng.geometric(0.15, len(words)) + 2
    bag = [w for w, c in zip(words, counts) for _ in range(c)]
    rng.shuffle(bag)
    rows = [(i if i % 7 else None, " ".join(bag[k : k + 40])) for i, k in enumerate(range(0, len(bag), 40))]
    rows += [(1, None), (2, ""), (3, "x1y2 don't"), (3, "häufig" * 20), (1, rows[1][1])]
    want = plain_variants(rows)
    for group in (20_000, 30, 2):
        assert variants(docs(spark, rows), group=group) == want
    assert sum(w[2] for w in want) > 100 and any(w[3] for w in want)
    assert variants(docs(spark, rows).limit(0)) == []


def test_roots_follow_chains(spark):
    """Each word occurs twice as often as the one before."""
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    rows = [(1000 + k, (w + " ") * (3 << k)) for k, w in enumerate(chain)]
    assert variants(docs(spark, rows)) == plain_variants(rows)
    assert {w[5] for w in plain_variants(rows)} == {"aaaabbbb"}


def test_wavelet_tree():
    rng = np.random.default_rng(6)
    for m in (1, 2, 3, 64, 100):
        values = rng.permutation(m)
        tree = spelling.WaveletTree(values)
        q = rng.integers(0, m + 1, (200, 4))
        got = sorted(zip(*map(np.ndarray.tolist, tree.report(*q.T))))
        assert got == sorted((i, int(v)) for i, (a, b, lo, hi) in enumerate(q) for v in values[a:b] if lo <= v < hi)


def test_variants_match_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(c.execute(f"SELECT word, n, n_near, form, form_n, root FROM ({spelling.ORACLE_SQL['op12_spelling_variants']})").fetchall())
    got = sorted(tuple(r) for r in spelling.op12_spelling_variants(spark, DATA).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == want and len(got) > 500


# whitening
def plain_whitening(rows, k=4):
    v = [(i, x) for i, x in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    sizes = Counter(len(x) for _, x in v)
    d = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    x = [(i, [math.floor(256 * c) for c in x]) for i, x in v if len(x) == d]
    fit = np.array(sorted(set(tuple(y) for _, y in x)), float)
    n, sums = len(fit), [sum(int(a) for a in c) for c in fit.T]
    cov = np.cov(fit.T, bias=True).reshape(d, d)
    values, vectors = np.linalg.eigh(cov)
    out = []
    for i, y in x:
        deviation = sum((n * a - s) ** 2 for a, s in zip(y, sums))
        deviation = deviation if deviation < 2**63 else None
        for c in range(min(k, d)):
            e, u = values[-1 - c], vectors[:, -1 - c]
            if e > 1e-12 * values[-1]:
                out.append((i, c + 1, n, deviation, abs((np.array(y) - fit.mean(axis=0)) @ u) / math.sqrt(e), e / np.trace(cov)))
    return out


def test_whitening(spark):
    rng = np.random.default_rng(7)
    rows = [(i, list(map(float, v))) for i, v in enumerate((rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))).astype(np.float32))]
    rows += [(5, rows[0][1]), (None, rows[1][1]), (400, None), (401, []), (402, [1.0, None] * 3), (403, [float("nan")] * 6), (404, [float("-inf")] * 6), (405, [1.0]), (406, [-0.0] * 6), (407, [9.5] * 6)]
    got = whitening.whiten(table(spark, rows)).collect()
    want = plain_whitening(rows)
    key = lambda r: (str(r[0]), r[1], r[3] or 0)
    have = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    want.sort(key=key)
    assert [w[:4] for w in have] == [w[:4] for w in want]
    assert np.allclose([w[4:] for w in have], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    line = [(i, [float(i), 2.0 * i]) for i in range(4)]
    assert [r.component for r in whitening.whiten(table(spark, line)).collect()] == [1] * 4  # one direction
    huge = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.5, 5.0])]
    got = whitening.whiten(table(spark, huge)).collect()
    assert len(got) >= 3 and all(r.deviation is None for r in got if r.vec_id != 3) and all(math.isfinite(r.whitened) for r in got)


def test_merging_moments_is_exact():
    rng = np.random.default_rng(8)
    x = rng.integers(-500, 500, (1000, 5))
    parts = [whitening.moments(p) for p in np.array_split(x, [1, 2, 300, 301])]
    total = parts[0]
    for p in parts[1:]:
        total = whitening.merged(total, p)
    assert total[0] == 1000 and total[3] == x.sum(axis=0).tolist()
    assert np.allclose(total[1], x.mean(axis=0)) and np.allclose(total[2] / 1000, np.cov(x.T, bias=True))
    none = (0, np.empty(0), np.empty((0, 0)), [])
    assert whitening.merged(none, parts[0]) is parts[0] and whitening.merged(parts[0], none) is parts[0]


def test_block_pairs_ship_no_vectors(spark, monkeypatch):
    """Each block is written once; the rows that the comparing stage shuffles are names of blocks, one a pair."""
    shuffled = []
    plain = ed._tiles

    def seen(pairs, nodes):
        out = plain(pairs, nodes)
        shuffled.append((pairs.columns, out.columns, out.count(), nodes.count()))
        return out

    monkeypatch.setattr(ed, "_tiles", seen)
    rows = list(enumerate(cloud(3, 120)))
    assert found(ed.near_vectors(table(spark, rows), block=20)) == brute(rows)
    ((given, kept, n, blocks),) = shuffled
    assert given == kept == ["a", "b"] and blocks > 5 and n <= blocks * (blocks - 1) // 2
