"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector o is rotated; the signs of its coordinates make a code, the
unit vector o' of entries +-1/sqrt(d). The stored correction factor <o', o>
turns <o', q> into an unbiased estimate <o', q> / <o', o> of <o, q>, with a
confidence bound of half width eps * sqrt((1 - <o',o>^2) / (d - 1)) / <o',o>.
The hard bound of Cauchy and Schwarz narrows it. Pairs whose interval ends
below the threshold are skipped; cosines of all others are recomputed.

Vectors are compared by pairs of tiles of their label. Equal vectors are one
row with a count. A pair of tiles yields, for each vector, its number of
links and a root, never the links themselves.

Defined results: vectors that are null, zero or hold null or non-finite
components, or whose label is null, link with nothing; vectors of different
lengths don't link; repeated rows link with each other; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise
from ._graph import components, roots
from ._vectors import matrix, valid

TILE = 1024
EPS = 8.0
SEED = 11


@cache
def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng((seed, d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factors <o', o> of unit vectors."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def uncertain(codes: np.ndarray, factors: np.ndarray, unit: np.ndarray, threshold: float, eps: float = EPS) -> np.ndarray:
    """(code, vector): whether the interval of the inner product reaches the threshold."""
    d = unit.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    s = (signs @ (unit @ rotation(d)).T.astype(np.float32)) / np.float32(np.sqrt(d))
    c = factors.astype(np.float32)[:, None]
    rest = np.sqrt(np.maximum(0, 1 - c * c))
    likely = s / c + eps * rest / (c * np.sqrt(max(1, d - 1)))
    certain = c * s + rest * np.sqrt(np.maximum(0, 1 - s * s))
    return np.minimum(likely, certain) >= threshold - 1e-4  # for float32


def compare(a: dict, b: dict | None, threshold: float, eps: float = EPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, links and root ids of the vectors that link in a pair of tiles (b None: within a)."""
    other = a if b is None else b
    na, nb = (np.sqrt((x["v"] * x["v"]).sum(1)) for x in (a, other))
    i, j = np.nonzero(uncertain(a["codes"], a["factors"], other["v"] / nb[:, None], threshold, eps))
    if b is None:
        i, j = i[i < j], j[i < j]
    hit = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        hit[at : at + len(p)] = (a["v"][p] * other["v"][q]).sum(1) / (na[p] * nb[q]) >= threshold
    i, j = i[hit], j[hit]
    n = len(a["id"])
    ids, shift = (a["id"], 0) if b is None else (np.concatenate([a["id"], b["id"]]), n)
    added = np.bincount(i, other["copies"][j], len(ids)) + np.bincount(j + shift, a["copies"][i], len(ids))
    root = roots(len(ids), i, j + shift)
    some = np.nonzero(added)[0]
    return ids[some], added[some].astype(np.int64), ids[root[some]]


def link(vectors: DataFrame, threshold: float = 0.93, eps: float = EPS) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    whole = vectors.select("vec_id", "embedding", "label", valid(F.col("embedding")).alias("ok"))
    reps = whole.where("ok and label is not null and vec_id is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    reps = materialise(reps.withColumn("d", F.size("embedding")))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            bits, factors = np.empty(len(dims), object), np.empty(len(dims))
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                x = matrix(batch.column(5).take(pa.array(at)))
                code, factors[at] = encode(x / np.sqrt((x * x).sum(1))[:, None])
                bits[at] = [c.tobytes() for c in code]
            yield pa.record_batch([*batch.columns, pa.array(bits, pa.binary()), pa.array(factors)], [*batch.schema.names, "code", "factor"])

    sizes = reps.groupBy("label", "d").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = reps.join(sizes, ["label", "d"]).select("label", "d", "tiles", "id", "copies", "embedding").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    dealt = dealt.select("label", "d", "tile", "id", "copies", "embedding", "tiles").mapInArrow(codes, f"label {vectors.schema['label'].dataType.simpleString()}, d int, tile int, id long, copies long, embedding {vectors.schema['embedding'].dataType.simpleString()}, tiles int, code binary, factor double")
    tiles = materialise(dealt.groupBy("label", "d", "tile", "tiles").agg(F.collect_list(F.struct("id", "copies", "embedding", "code", "factor")).alias("rows")))
    key = ["label", "d", "i", "j"]
    left = tiles.select("label", "d", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), F.col("rows").alias("a"))
    right = tiles.select("label", "d", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"), F.when(F.lit(True), F.col("rows")).alias("b"))
    pairs = left.join(right, key).select("a", F.when(F.col("i") < F.col("j"), F.col("b")).alias("b"))

    def side(rows: pa.Array) -> dict:
        v = matrix(rows.field(2))
        code = np.frombuffer(b"".join(rows.field(3).to_pylist()), np.uint8).reshape(len(rows), -1)
        return {"id": np.asarray(rows.field(0)), "copies": np.asarray(rows.field(1)), "v": v, "codes": code, "factors": np.asarray(rows.field(4))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                ids, added, root = compare(side(a.values), side(b.values) if b.is_valid else None, threshold, eps)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(added), pa.array(root, pa.int64())], ["id", "added", "root"])

    found = materialise(pairs.mapInArrow(run, "id long, added long, root long"))
    counts = found.groupBy("id").agg(F.sum("added").alias("added"))
    labels = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "id")
    told = reps.join(counts, "id", "left").join(labels, "id", "left").select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), "id", "copies", "added", "component")
    on = (whole["label"] == told["_l"]) & (whole["embedding"] == told["_e"]) & whole["ok"]
    least = F.coalesce("component", "id", "vec_id")
    return whole.join(told, on, "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("added", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), least).alias("component_id"),
        F.col("vec_id").eqNullSafe(F.when(F.col("vec_id").isNotNull(), least)).alias("kept"),
    )


def query(embeddings: DataFrame) -> DataFrame:
    return link(embeddings)
