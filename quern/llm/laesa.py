"""Centroid clustering over a pivot table (LAESA), in exact integers.

Every vector's distances to fixed pivots, the first centroids, are computed
once and stored beside it. In each round the centroids' distances to the same
pivots bound every vector's distance to every centroid from below: by the
triangle inequality it is at least the largest difference of the two over the
pivots. The centroid of the least bound gives an upper bound, and only
centroids whose bound doesn't exceed it receive an exact squared distance.
Bounds are taken off by more than their rounding, so none that could win or
tie is left out.

A round is one pass over the table: tasks add up their vectors by centroid and
send one row a centroid; what the driver holds is centroids x components.

Defined results: vectors that are null, of another number of components, or
hold a null or non-finite component take no part and have no row; zero vectors
do; equal distances go to the smaller centroid; repeated rows count each and
have a row each; rows of one vec_id (or none: "1:") tie for a first centroid
and the one with the smaller components is taken; fewer vectors than centroids
give fewer centroids; an empty table gives no row; extra columns are ignored,
whatever their names; long texts don't occur. A scaled component beyond 2^27
raises, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

LIMIT = 1 << 27  # 64 components that differ by twice as much have a squared distance of 2^62
ROWS = 4096  # vectors whose bounds are held at once
SLACK = 1e-12  # of the distances that a bound is made of: far more than their rounding
TABLE = "vec_id long, v array<long>, pivot array<double>"


def scaled(vectors: DataFrame, dims: int = 64, factor: float = 64.0) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, v: floor(factor * component), of the vectors that take part."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * factor))
    fits = ~F.exists(x, lambda c: F.abs(c.cast("double")) * factor > LIMIT)
    v = F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<long>"))
    return vectors.where((F.size(x) == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_key(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, from exact squares."""
    out = np.empty((len(x), len(to)))
    for j, c in enumerate(to):
        d = x - c
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64))
    return out


def nearest(x: np.ndarray, pivot: np.ndarray, centroids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """x (n, dims), pivot (n, pivots): their distances; centroids (k, dims), known (k, pivots) -> nearest centroid, squared distance, exact distances computed."""
    n, everyone = len(x), np.arange(len(x))

    def exact(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        d = x[rows] - centroids[which]
        return np.einsum("ij,ij->i", d, d)

    low = np.zeros((n, len(centroids)))
    for p in range(pivot.shape[1]):
        a, b = pivot[:, p, None], known[None, :, p]
        np.maximum(low, np.abs(a - b) - SLACK * (a + b), out=low)
    guess = np.argmin(low, axis=1)
    squares = np.full(low.shape, np.iinfo(np.int64).max)
    squares[everyone, guess] = exact(everyone, guess)
    most = np.sqrt(squares[everyone, guess].astype(np.float64)) * (1 + SLACK)
    live = low <= most[:, None]
    live[everyone, guess] = False
    rows, which = np.nonzero(live)
    squares[rows, which] = exact(rows, which)
    best = np.argmin(squares, axis=1)  # the first of equals
    return best, squares[everyone, best], n + len(rows)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors (vec_id, v) with their distances to the pivots, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                d = distances(_rows(some.column(1), np.int64), pivots)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * len(pivots), pa.int32()), pa.array(d.ravel()))
                yield pa.record_batch([some.column(0), some.column(1), held], ["vec_id", "v", "pivot"])

    return materialise(vectors.mapInArrow(run, TABLE))


def assigned(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """table (vec_id, v, pivot) -> vec_id, cluster, distance (squared)."""
    known = distances(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                which, square, _ = nearest(_rows(some.column(1), np.int64), _rows(some.column(2), np.float64), centroids, known)
                yield pa.record_batch([some.column(0), pa.array(which, pa.int32()), pa.array(square)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The next round's centroids: floor(sum / count) of each one's vectors; those without vectors stay."""
    known, dims = distances(centroids, pivots), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                x = _rows(some.column(1), np.int64)
                which, _, _ = nearest(x, _rows(some.column(2), np.float64), centroids, known)
                np.add.at(sums, which, x)
                counts += np.bincount(which, minlength=len(counts))
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * dims, pa.int32()), pa.array(sums.ravel()))
        yield pa.record_batch([pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts), held], ["cluster", "n", "sums"])

    parts = table.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums")).collect()  # a row a centroid
    out = centroids.copy()
    for r in total:
        if r["n"]:
            out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, factor: float = 64.0, seed: int = 1) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    kept = scaled(vectors, dims, factor)
    first = kept.orderBy(first_key(F.col("vec_id"), seed), "v").limit(k).collect()  # k vectors
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    pivots = centroids = np.array([r["v"] for r in first], np.int64)
    table = pivot_table(kept, pivots)
    for _ in range(rounds):
        centroids = moved(table, pivots, centroids)
    out = materialise(assigned(table, pivots, centroids))
    own = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # at most k rows
    every = own.agg(F.sum("cluster_inertia").alias("inertia"))
    names = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()))
    both = out.join(F.broadcast(own), "cluster").crossJoin(F.broadcast(every))
    return both.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", names[F.col("cluster")].alias("centroid_sha256"))


def query(vectors: DataFrame) -> DataFrame:
    return cluster(vectors)


def sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """The same by comparing every vector with every centroid. The numbers are small enough for exact doubles."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h, v LIMIT {k}))""",
    ]
    near = "arg_min(c.j, (list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v), c.j))"
    least = "min(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v))"
    for i in range(rounds):
        steps += [
            f"n{i} AS MATERIALIZED (SELECT p.r, any_value(p.v) AS v, {near} AS j FROM (SELECT row_number() OVER () AS r, v FROM kept) p, c{i} c GROUP BY p.r)",
            f"""m{i} AS MATERIALIZED (SELECT j, list(x ORDER BY i) AS v FROM (SELECT j, i, floor(sum(x) / count(*)) AS x FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n{i}) GROUP BY j, i) GROUP BY j)""",
            f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j)",
        ]
    last = f"c{rounds}"
    return f"""WITH {", ".join(steps)}, f AS (SELECT p.r, any_value(p.vec_id) AS vec_id, {near} AS j, {least} AS d FROM (SELECT row_number() OVER () AS r, vec_id, v FROM kept) p, {last} c GROUP BY p.r)
  SELECT vec_id, f.j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY f.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM f JOIN {last} c ON c.j = f.j"""


SQL = sql()
