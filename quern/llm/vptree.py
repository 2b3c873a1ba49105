"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

Largest inner product is nearest Euclidean neighbour after one coordinate
sqrt(M^2 - |x|^2) is added to vectors and 0 to queries, M the largest norm of
all; so the triangle inequality holds. What lies further from a query than
`factor` times the distance of its worst neighbour so far is skipped: shells
of a tree, and whole regions of the index. Factor 1 is exact; less skips more.

build() deals vectors to the nearest of a few vantage points, which are drawn
from the vectors; a region of many vectors is split in shards of bounded
size. Each shard's tree is grown once and kept as a row, with the region's
radius. search() asks the query's own region first, then, with the bound from
there, the regions that could still hold something nearer. Blocks of queries
meet trees by a join.

Distances only prune, with a margin for rounding. What is returned is ranked
by inner products in double precision of the original vectors, then by id.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do null ids; vectors of another length than the
query's are no candidates; ties go to the smaller id, whatever their number;
rows that repeat an id are candidates each, except for queries with that id;
queries that repeat an id and a vector are one query, and with another vector
a query of its own under the same id; no candidates: no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise
from ._vectors import matrix, valid

SHARD = 8192  # vectors of a shard, on average at most
BLOCK = 2048  # queries of a block
LEAF = 512
REGIONS = 1024  # vantage points of regions at most: they are broadcast


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one way whatever the batch."""
    return (x * q).sum(1)


def distances(x: np.ndarray, norms: np.ndarray, y: np.ndarray, y_norms: np.ndarray, top: float) -> np.ndarray:
    """(x, y) with the coordinate added; norms are squared, `top` is M^2; pass y_norms = None for queries, whose coordinate is 0."""
    x_more = np.sqrt(np.maximum(0, top - norms))
    y_more = np.zeros(len(y)) if y_norms is None else np.sqrt(np.maximum(0, top - y_norms))
    y_own = (y * y).sum(1) if y_norms is None else np.full(len(y), top)
    return np.sqrt(np.maximum(0, top + y_own[None] - 2 * (x @ y.T + x_more[:, None] * y_more[None])))


class Tree:
    """A vantage-point tree. Leaves are runs of rows; an inner node has a vantage row, and for each child the least and the greatest distance from it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, leaf: int = LEAF, seed: int = 5):
        self.ids, self.x, self.top = ids, x, top
        self.norms = (x * x).sum(1)
        self.rng, self.leaf = np.random.default_rng(seed), leaf
        self.nodes: list[tuple] = []  # (vantage, (child, low, high) twice) or (start, end)
        order: list[np.ndarray] = []
        self._grow(np.arange(len(x)), order)
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.ids, self.x, self.norms = self.ids[order], self.x[order], self.norms[order]
        self.nodes = [n if len(n) == 2 else (int(place[n[0]]), *n[1:]) for n in self.nodes]

    def _grow(self, members: np.ndarray, order: list[np.ndarray]) -> int:
        number = len(self.nodes)
        self.nodes.append(())
        if len(members) > self.leaf:
            v = int(members[self.rng.integers(len(members))])
            d = distances(self.x[members], self.norms[members], self.x[v][None], self.norms[v][None], self.top)[:, 0]
            inside = d <= np.median(d)
            if 16 * min(inside.sum(), (~inside).sum()) >= len(members):  # else nearly all lie at one distance: nothing to split by
                children = []
                for some in (inside, ~inside):
                    children.append((self._grow(members[some], order), float(d[some].min()), float(d[some].max())))
                self.nodes[number] = (v, *children)
                return number
        at = sum(map(len, order))
        order.append(members)
        self.nodes[number] = (at, at + len(members))
        return number

    def dump(self) -> bytes:
        flat = [(n[0], n[1], -1, 0.0, 0.0, 0.0, 0.0) if len(n) == 2 else (n[0], n[1][0], n[2][0], *n[1][1:], *n[2][1:]) for n in self.nodes]
        out = io.BytesIO()
        x = self.x.astype(np.float32)
        np.savez(out, ids=self.ids, x=x if (x == self.x).all() else self.x, nodes=np.array(flat, np.float64).reshape(-1, 7), top=self.top)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree, held = cls.__new__(cls), np.load(io.BytesIO(data))
        tree.ids, tree.x, tree.top = held["ids"], held["x"].astype(np.float64), float(held["top"])
        tree.norms = (tree.x * tree.x).sum(1)
        tree.nodes = [(int(a), int(b)) if c < 0 else (int(a), (int(b), l1, h1), (int(c), l2, h2)) for a, b, c, l1, h1, l2, h2 in held["nodes"].tolist()]
        return tree

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query's place, id, score: at least the k best of each query, ties by id, without rows of its own id; floor: scores below aren't wanted."""
        n = len(q)
        self.q, self.own, self.k, self.factor = q, own, k, factor
        self.size = (q * q).sum(1)
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.score, self.found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.slack = 1e-12 * (1 + np.sqrt(self.size) * np.sqrt(max(self.top, 0.0)))
        self._visit(0, np.arange(n))
        row, rank = np.nonzero(self.score > -np.inf)
        return row, self.found[row, rank], self.score[row, rank]

    def bound(self, rows: np.ndarray) -> np.ndarray:
        """Distance at which the worst neighbour so far lies, times the factor, with a margin for rounding."""
        worst = np.maximum(self.score[rows, -1], self.floor[rows])
        far = np.sqrt(np.maximum(0, self.top + self.size[rows] - 2 * np.where(np.isfinite(worst), worst, 0)))
        return np.where(np.isfinite(worst), self.factor * far + 1e-7 * np.sqrt(self.top + self.size[rows]), np.inf)

    def _visit(self, node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        n = self.nodes[node]
        if len(n) == 2:
            self._scan(slice(*n), rows)
            return
        v, *children = n
        d = distances(self.x[v][None], self.norms[v][None], self.q[rows], None, self.top)[0]
        gaps = [np.maximum(0, np.maximum(low - d, d - high)) for _, low, high in children]
        first = gaps[0] <= gaps[1]  # each query's nearer child comes first, so that its bound is close at the other
        for some, (a, b) in ((first, (0, 1)), (~first, (1, 0))):
            for child in (a, b):
                here = rows[some]
                self._visit(children[child][0], here[gaps[child][some] <= self.bound(here)])

    def _scan(self, members: slice, rows: np.ndarray) -> None:
        x, ids = self.x[members], self.ids[members]
        step = max(1, (1 << 20) // max(1, len(x)))
        for part in (rows[at : at + step] for at in range(0, len(rows), step)):
            least = np.maximum(self.score[part, -1], self.floor[part]) - self.slack[part]
            near = np.where(ids[None] == self.own[part][:, None], -np.inf, self.q[part] @ x.T)
            many = np.nonzero((near >= least[:, None]).sum(1) > self.k)[0]
            if len(many):  # what lies below a leaf's own k best by more than rounding is none of the k best
                kth = np.partition(near[many], -self.k, axis=1)[:, -self.k]
                least[many] = np.maximum(least[many], kth - 2 * self.slack[part[many]])
            i, j = np.nonzero((near >= least[:, None]) & (near > -np.inf))
            for some in (slice(at, at + (1 << 16)) for at in range(0, len(i), 1 << 16)):
                self._merge(part, i[some], ids[j[some]], products(x[j[some]], self.q[part[i[some]]]))

    def _merge(self, part: np.ndarray, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched, i = np.unique(i, return_inverse=True)
        rows = part[touched]
        own = np.repeat(np.arange(len(rows)), self.k)
        row = np.concatenate([own, i])
        score = np.concatenate([self.score[rows].ravel(), scores])
        found = np.concatenate([self.found[rows].ravel(), ids])
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row]
        best = rank < self.k
        self.score[rows], self.found[rows] = score[best].reshape(-1, self.k), found[best].reshape(-1, self.k)


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """vectors (vec_id, embedding) -> id, embedding, d: of equal vectors the k + 1 smallest ids, each k times at most, as no other row can be among a query's k best."""
    rows = vectors.where("vec_id is not null").where(valid(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), "embedding")
    rows = rows.groupBy("embedding", "id").agg(F.count("*").alias("copies"))
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("id"))
    each = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("_copy")
    return rows.withColumn("_n", first).where(F.col("_n") <= k + 1).select("id", "embedding", F.size("embedding").alias("d"), each).drop("_copy")


def build(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]], float]:
    """candidates() -> trees (d, region, shard, tree), vantage points and radii of the regions of each length of vectors, and M^2."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "d")
    top = (sizes.agg(F.max("top")).first()[0] or 0.0) * (1 + 1e-12)
    points: dict[int, np.ndarray] = {}
    left = REGIONS
    for d, n, _ in sizes.limit(64).collect():  # other lengths, of which few vectors are, have one region
        want = min(left, -(-n // SHARD))
        if want > 1:
            drawn = rows.where(F.col("d") == d).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(want).select("embedding")
            points[d] = np.array([r[0] for r in drawn.collect()], np.float64)
            left -= want
    sent = rows.sparkSession.sparkContext.broadcast(points)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            region, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                if d in sent.value:
                    at = np.nonzero(dims == d)[0]
                    x, p = matrix(batch.column(1).take(pa.array(at))), sent.value[d]
                    away = distances(x, (x * x).sum(1), p, (p * p).sum(1), top)
                    region[at], far[at] = away.argmin(1), away.min(1)
            yield pa.record_batch([*batch.columns, pa.array(region), pa.array(far)], [*batch.schema.names, "region", "far"])

    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = materialise(rows.mapInArrow(place, f"id long, embedding {kind}, d int, region int, far double"))
    found = dealt.groupBy("d", "region").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    radii = {d: np.full(len(p), -np.inf) for d, p in points.items()}
    for r in found.where(F.col("d").isin(list(points) or [-1])).collect():  # REGIONS rows at most
        radii[r["d"]][r["region"]] = r["radius"]
    shards = found.select("d", "region", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"))
    keyed = dealt.join(shards, ["d", "region"]).withColumn("shard", F.pmod(F.xxhash64("id", "embedding"), "shards").cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        tree = Tree(table["id"].to_numpy(), matrix(table["embedding"]), top)
        return pa.table([table[c].slice(0, 1) for c in ("d", "region", "shard")] + [pa.array([tree.dump()], pa.binary())], ["d", "region", "shard", "tree"])

    trees = keyed.select("d", "region", "shard", "id", "embedding").groupBy("d", "region", "shard").applyInArrow(grow, "d int, region int, shard int, tree binary")
    return materialise(trees), {d: (p, radii[d]) for d, p in points.items()}, top


def search(trees: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """trees and asked (key, id, embedding, d, region, floor) -> key, id, score: what each tree finds for the queries of its region."""
    block = F.floor((F.row_number().over(Window.partitionBy("d", "region", "_part").orderBy("key")) - 1) / BLOCK)
    parts = asked.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("_block", block)
    packed = F.collect_list(F.struct("key", "id", "floor", "embedding")).alias("queries")
    blocks = parts.groupBy("d", "region", "_part", "_block").agg(packed).select("d", "region", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, Tree] | None = None
        for batch in batches:
            for data, queries in zip(batch.column(0), batch.column(1), strict=True):
                data, queries = data.as_py(), queries.values
                if held is None or held[0] != data:
                    held = data, Tree.load(data)
                key, own, floor = (np.asarray(queries.field(i)) for i in range(3))
                row, ids, score = held[1].search(matrix(queries.field(3)), own, k, factor, floor)
                yield pa.record_batch([pa.array(key[row]), pa.array(ids), pa.array(score)], ["key", "id", "score"])

    return trees.join(blocks, ["d", "region"]).select("tree", "queries").mapInArrow(run, "key long, id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score for the rows that is_query marks."""
    spark = vectors.sparkSession
    rows = materialise(candidates(vectors, k))
    trees, regions, top = build(rows)
    asked = vectors.where("vec_id is not null").where(valid(F.col("embedding"))).where(is_query).select(F.col("vec_id").cast("long").alias("id"), "embedding").distinct()
    asked = asked.select(F.xxhash64("id", "embedding").alias("key"), "id", "embedding", F.size("embedding").alias("d"))
    sent = spark.sparkContext.broadcast(regions)
    kind = vectors.schema["embedding"].dataType.simpleString()
    schema = f"key long, id long, embedding {kind}, d int, floor double, region int"

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each region that a query asks: its nearest, or the others within its bound."""
            for batch in batches:
                dims, floor = np.asarray(batch.column(3)), np.asarray(batch.column(4))
                take, to = [], []
                for d in np.unique(dims):
                    at = np.nonzero(dims == d)[0]
                    if d not in sent.value:
                        if first:
                            take.append(at)
                            to.append(np.zeros(len(at), np.int32))
                        continue
                    points, radii = sent.value[d]
                    q = matrix(batch.column(2).take(pa.array(at)))
                    away = distances(points, (points * points).sum(1), q, None, top).T
                    own = np.arange(len(points))[None] == away.argmin(1)[:, None]
                    if first:
                        i, r = np.nonzero(own)
                    else:
                        size = (q * q).sum(1)
                        worst = floor[at]
                        far = np.sqrt(np.maximum(0, top + size - 2 * np.where(np.isfinite(worst), worst, 0)))
                        bound = np.where(np.isfinite(worst), factor * far + 1e-7 * np.sqrt(top + size), np.inf)
                        i, r = np.nonzero(~own & (away - radii[None] <= bound[:, None]))
                    take.append(at[i])
                    to.append(r.astype(np.int32))
                if take:
                    yield pa.record_batch([*batch.take(pa.array(np.concatenate(take))).columns, pa.array(np.concatenate(to))], [*batch.schema.names, "region"])

        return run

    asked = materialise(asked.withColumn("floor", F.lit(float("-inf"))))
    near = materialise(search(trees, asked.mapInArrow(route(True), schema), k, factor))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    if regions:
        floors = near.withColumn("_n", best).where(F.col("_n") == k).select("key", F.col("score").alias("_floor"))
        again = asked.join(floors, "key", "left").select("key", "id", "embedding", "d", F.coalesce("_floor", "floor").alias("floor"))
        near = near.unionByName(search(trees, again.mapInArrow(route(False), schema), k, factor))
    some = near.withColumn("_n", best).where(F.col("_n") <= k).select("key", "id", "score")
    some = some.join(asked.select("key", F.col("id").alias("query_id")), "key").select("key", "query_id", F.col("id").alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return some.select("query_id", rank.alias("rank"), "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 20 == 0, 20, FACTOR)


#: Pruning factor of the registered query; README has its recall.
FACTOR = 1.0
