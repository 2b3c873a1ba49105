"""Vector expressions over ARRAY columns; sums are in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, not at each place where `use` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def l2_normalize(a: Column, mode: str = "add") -> Column:
    """mode: add (norm + 1e-8), clip (norm, 1e-12 at least), keep (unchanged at norm 1e-12 or less)."""

    def divided(v: Column, n: Column) -> Column:
        if mode == "add":
            return F.transform(v, lambda x: x / (n + 1e-8))
        if mode == "clip":
            return F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12)))
        return F.when(n <= 1e-12, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / n))

    return F.when(a.isNotNull(), bind(a, lambda v: bind(norm(v), lambda n: divided(v, n))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def exploded(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """A row for each component: the columns in `keep`, pos, x."""
    return df.select(*keep, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def summed(rows: DataFrame, key: str, vector: str, how: str = "sum") -> DataFrame:
    """rows (key, vector[, _w]) -> key, pos, x, w: sums of weighted vectors (or maxima) and of weights.

    Whole vectors are reduced in each batch first, so a key's partial vectors are shuffled, not its rows by component.
    """
    weighted = "_w" in rows.columns
    live = rows.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"), (F.col("_w") if weighted else F.lit(1.0)).cast("double").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            size = np.asarray(pc.list_value_length(batch.column(1)))
            values, starts = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            codes, w = np.asarray(coded.indices.fill_null(len(coded.dictionary))), np.asarray(batch.column(2))
            keys, parts, weights = [], [], []
            order = np.lexsort((size, codes))
            new = np.nonzero(np.append(True, (codes[order][1:] != codes[order][:-1]) | (size[order][1:] != size[order][:-1])))[0] if len(order) else []
            for some in np.split(order, new[1:]) if len(order) else ():
                x = values[starts[some][:, None] + np.arange(size[some[0]])]
                keys.append(batch.column(0)[int(some[0])].as_py())
                parts.append(x.max(0) if how == "max" else w[some] @ x)
                weights.append(w[some].sum())
            yield pa.record_batch([pa.array(keys, batch.column(0).type), pa.array(parts, pa.list_(pa.float64())), pa.array(weights, pa.float64())], ["key", "v", "w"])

    parts = live.mapInArrow(run, f"key {rows.schema[key].dataType.simpleString()}, v array<double>, w double")
    each = parts.select(F.col("key").alias(key), "w", F.posexplode("v").alias("pos", "x"))
    return each.groupBy(key, "pos").agg((F.max if how == "max" else F.sum)("x").alias("x"), F.sum("w").alias("w"))


def pool(df: DataFrame, key: str, vector: str, how: str = "mean", weight: Column | None = None, temperature: float = 15.0) -> DataFrame:
    """Pools the vectors of a key: mean, max, weighted, or softmax around the centre. Null vectors don't count. -> key, pos, x (unit)."""
    live = df.where(F.col(vector).isNotNull())
    if how == "softmax":
        unit = live.select(key, l2_normalize(F.col(vector)).alias(vector))
        centre = pool(unit, key, vector).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_c"))
        scored = unit.join(centre, key).withColumn("_s", temperature * dot(F.col(vector), F.transform("_c", lambda c: c["x"])))
        top = scored.groupBy(key).agg(F.max("_s").alias("_top"))
        found = summed(scored.join(top, key).select(key, vector, F.exp(F.col("_s") - F.col("_top")).alias("_w")), key, vector)
        means = found.select(key, "pos", (F.col("x") / F.col("w")).alias("x"))
    elif how == "weighted":
        means = summed(live.select(key, vector, weight.alias("_w")), key, vector).select(key, "pos", (F.col("x") / (F.col("w") + 1e-8)).alias("x"))
    elif how == "max":
        means = summed(live, key, vector, "max").select(key, "pos", "x")
    else:
        means = summed(live.select(key, vector), key, vector).select(key, "pos", (F.col("x") / F.col("w")).alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return means.withColumn("x", F.col("x") / (size + 1e-8))


def multi_pool(df: DataFrame, keys: DataFrame, key: str, vector: str, d: int, how: tuple[str, ...] = ("mean", "max", "softmax")) -> DataFrame:
    """keys (key) -> key, has (whether it has a vector) and a column for each pool, zeros of length d where there is none."""
    out = keys.select(key).distinct()
    for h in how:
        rows = pool(df, key, vector, h).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias(h))
        out = out.join(rows, key, "left")
    return out.select(key, F.col(how[0]).isNotNull().alias("has"), *(F.coalesce(h, F.array_repeat(F.lit(0.0), d)).alias(h) for h in how))


def weighted_mean(items: Column) -> Column:
    """items: array of (w, v) -> the unit mean of their vectors by weight; null if there is none."""
    weight = F.aggregate(items, F.lit(0.0), lambda s, i: s + i["w"]) + 1e-8
    zero = F.transform(items[0]["v"], lambda x: x.cast("double") * 0)
    total = F.aggregate(items, zero, lambda s, i: F.zip_with(s, i["v"], lambda a, b: a + i["w"] * b))
    return F.when(F.size(items) > 0, l2_normalize(bind(weight, lambda w: F.transform(total, lambda x: x / w))))
