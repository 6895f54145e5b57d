"""Whitening of embeddings by merged partition statistics.

Entries become integers x = floor(256 * c), and each distinct x vector counts once. Every partition
computes count, mean and centred scatter of its vectors; two such triples merge by Chan's formula, in
a tree, so the driver gets one matrix of d x d numbers however many rows there are. Eigenvectors of
the covariance project the rows; a second pass over the distinct vectors gathers the covariance of
what was projected in the same way and measures how far from the identity it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import free_memory, written

SCALE, COMPONENTS = 256, 4
#: An eigenvalue of no more than this part of the largest is no direction to scale by.
RANK = 1e-12
#: Vectors in one centred product, at most.
CHUNK = 8192

Moments = tuple[int, np.ndarray, np.ndarray, list[int]]


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """The rows of a list column whose lists all have `width` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def moments(x: np.ndarray) -> Moments:
    """Count, mean, centred scatter, and the exact sums of integer vectors."""
    mean = x.mean(axis=0, dtype=np.float64)
    c = x - mean
    if x.dtype != np.int64:
        return len(x), mean, c.T @ c, []
    wide = max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 2**63
    return len(x), mean, c.T @ c, [int(s) for s in x.sum(axis=0, dtype=object if wide else np.int64)]


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise formula."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n), [s + t for s, t in zip(a[3], b[3])]


def gathered(df: DataFrame, chunks) -> Moments:
    """The moments of all vectors that `chunks` makes of df's batches (df isn't empty): one triple a partition, merged in a tree."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Moments | None = None
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                m = moments(chunks(b.slice(at, CHUNK)))
                total = m if total is None else merged(total, m)
        if total is not None:
            n, mean, scatter, sums = total
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tobytes()], "scatter": [scatter.tobytes()], "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})
        free_memory()

    def triple(r) -> Moments:
        mean = np.frombuffer(r.mean, np.float64)
        return r.n, mean, np.frombuffer(r.scatter, np.float64).reshape(len(mean), -1), [int(s) for s in r.sums]

    return df.mapInArrow(one, "n long, mean binary, scatter binary, sums array<string>").rdd.map(triple).treeReduce(merged, depth=3)


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows that remain: x = floor(SCALE * entry) as long, for vectors of the commonest length."""
    vec = F.col("v")
    rows = df.select(df[id_col].alias("id"), df[vec_col].cast("array<double>").alias("v"))
    whole = rows.where(vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    lengths = whole.groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("rows"))
    common = lengths.agg(F.max(F.struct("rows", "d")).getField("d").alias("d"))
    x = F.transform(vec, lambda c: F.floor(c * SCALE).cast("long"))
    return whole.join(F.broadcast(common), F.size(vec) == F.col("d")).select("id", x.alias("x"))


def _projected(x: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return (x - mean) @ basis


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)^2, exact; null where it is over a long's range."""
    reach = max((abs(n * int(v) - s) for row in (x.min(axis=0), x.max(axis=0)) for v, s in zip(row, sums)), default=0)
    if reach * reach * len(sums) < 2**63:
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def _whitened(batches: Iterator[pa.RecordBatch], id_col: str, n: int, sums: list[int], mean: np.ndarray, basis: np.ndarray, explained: list[float], error: float) -> Iterator[pa.RecordBatch]:
    k = basis.shape[1]
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            part = b.slice(at, CHUNK)
            x = matrix(part.column("x"), len(mean), np.int64)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array([v for v in _deviations(x, n, sums) for _ in range(k)], pa.int64()), pa.array(_projected(x, mean, basis).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )
    free_memory()


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per remaining row and component: `id_col`, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds null or non-finite entries, are dropped, and so are those
    whose length isn't the commonest one (of equally common ones the longest stays). Rows that share an id
    or a vector each get their own answer; null ids stay null. Entries beyond a long's range are held at
    its ends. Directions without variance are no components, so equal vectors or an empty table give no
    rows. deviation is null where its exact value is over a long's range. Further columns aren't looked at.
    """
    spark = df.sparkSession
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(integers(df, id_col, vec_col), "integers")
    fit = written(rows.select("x").distinct(), "distinct")
    first = fit.first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = len(first.x)
    n, mean, scatter, sums = gathered(fit, lambda b: matrix(b.column("x"), width, np.int64))
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = [j for j in range(min(components, width)) if values[j] > max(RANK * values[0], 0.0)]
    if not top:
        return spark.createDataFrame([], schema)
    basis, explained = vectors[:, top] / np.sqrt(values[top]), (values[top] / np.trace(scatter / n)).tolist()
    second = gathered(fit, lambda b: _projected(matrix(b.column("x"), width, np.int64), mean, basis))
    error = float(np.abs(second[2] / n - np.eye(len(top))).max())
    return rows.mapInArrow(partial(_whitened, id_col=id_col, n=n, sums=sums, mean=mean, basis=basis, explained=explained, error=error), schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: SQL has no eigenvectors; tests/llm holds the query against numpy.
QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLE_SQL: dict[str, str] = {}
