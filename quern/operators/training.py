"""What a trainer of retrieval models reads from its data: soft positive weights and the losses of whole batches.

Losses compare every query of a batch with every item of it, as they are
defined; the matrix is never written out. A batch is dealt to blocks of about
BLOCK rows; a task multiplies one block of queries by one of items and sends,
for each row and column, its largest logit and the sum of exponentials against
it, which are merged by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as vx

BLOCK = 1024


def soft_positives(captions: DataFrame, shots: DataFrame, similarity: float = 0.8, overlap: float = 0.2, temperature: float = 0.07) -> DataFrame:
    """captions (sample, emb), shots (sample, pos, emb, overlap; a null emb is masked) -> sample, pos, weight.

    A softmax over a sample's shots of similarity * (caption . shot) + overlap * (its subtitle's overlap), over the
    temperature. Masked shots weigh 0; where all are masked, so do all.
    """
    score = similarity * vx.dot(F.col("_c"), F.col("emb")) + overlap * F.coalesce("overlap", F.lit(0.0))
    logits = shots.join(captions.select("sample", F.col("emb").alias("_c")), "sample").select("sample", "pos", F.when(F.col("emb").isNotNull(), score / max(temperature, 1e-6)).alias("_l"))
    listed = logits.groupBy("sample").agg(F.collect_list(F.struct("pos", "_l")).alias("_s"), F.max("_l").alias("_top"))  # a sample's shots are few
    raised = F.transform("_s", lambda x: F.struct(x["pos"].alias("pos"), F.coalesce(F.exp(x["_l"] - F.col("_top")), F.lit(0.0)).alias("w")))
    each = listed.select("sample", raised.alias("_s")).withColumn("_t", F.aggregate("_s", F.lit(0.0), lambda a, x: a + x["w"]))
    return each.select("sample", "_t", F.explode("_s").alias("x")).select("sample", "x.pos", F.when(F.col("_t") > 0, F.col("x.w") / F.col("_t")).otherwise(0.0).alias("weight"))


def _blocks(df: DataFrame, counts: DataFrame, id_: str, side: str) -> DataFrame:
    """df (batch, id, emb) -> batch, block, `side` (array of structs id, emb): rows are dealt by hash."""
    dealt = df.join(counts, "batch").withColumn("_b", F.pmod(F.xxhash64(id_), F.col("blocks")))
    return dealt.groupBy("batch", F.col("_b").alias(f"{side}_block")).agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct(F.col(id_).cast("long").alias("id"), F.transform("emb", lambda x: x.cast("double")).alias("emb"))).alias(side))


def log_sums(queries: DataFrame, items: DataFrame, temperature: float, both: bool = False) -> DataFrame:
    """queries, items (batch, id, emb) -> batch, side, id, log_sum: the logarithm of the sum of exp(query . item / temperature) over the batch's items for each query (side q) and, if both, over its queries for each item (side i)."""
    counts = queries.select("batch").unionByName(items.select("batch")).groupBy("batch").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("blocks"))
    left, right = _blocks(queries, counts, "id", "q"), _blocks(items, counts, "id", "i").drop("blocks")
    pairs = left.withColumn("i_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks").join(right, ["batch", "i_block"])

    def matrix(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(held.field("id"))
        return ids, np.asarray(held.field("emb").flatten(), np.float64).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                q, x = matrix(batch.column(1)[at].values)
                i, y = matrix(batch.column(2)[at].values)
                s = x @ y.T / temperature
                for side, ids, axis in (("q", q, 1), ("i", i, 0))[: 2 if both else 1]:
                    top = s.max(axis)
                    total = np.exp(s - np.expand_dims(top, axis)).sum(axis)
                    key = pa.array([batch.column(0)[at].as_py()] * len(ids), batch.column(0).type)
                    yield pa.record_batch([key, pa.array([side] * len(ids)), pa.array(ids), pa.array(top), pa.array(total)], ["batch", "side", "id", "top", "total"])

    parts = pairs.select("batch", "q", "i").mapInArrow(run, f"batch {dict(queries.dtypes)['batch']}, side string, id long, top double, total double")
    by = parts.groupBy("batch", "side", "id").agg(F.max("top").alias("_top"), F.collect_list(F.struct("top", "total")).alias("_p"))  # one for each block of the other side
    total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["total"] * F.exp(p["top"] - F.col("_top")))
    return by.select("batch", "side", "id", (F.col("_top") + F.log(total)).alias("log_sum"))


def contrastive_loss(queries: DataFrame, items: DataFrame, temperature: float = 0.07) -> DataFrame:
    """queries, items (batch, id, emb), paired by id -> batch, n, loss: cross entropy of the pairs, mean of both directions. Rows without their pair or a vector take no part."""
    live = lambda df: df.where("emb is not null").select("batch", "id", "emb")
    key = ["batch", "id"]
    pairs = live(queries).join(live(items).select(*key, F.col("emb").alias("_i")), key)
    own = pairs.select(*key, (vx.dot(F.col("emb"), F.col("_i")) / temperature).alias("own"))
    sums = log_sums(pairs.select(*key, "emb"), pairs.select(*key, F.col("_i").alias("emb")), temperature, both=True)
    return sums.join(own, key).groupBy("batch").agg(F.count_if(F.col("side") == "q").alias("n"), (F.sum(F.col("log_sum") - F.col("own")) / F.count("*")).alias("loss"))


def shot_loss(queries: DataFrame, shots: DataFrame, weights: DataFrame, temperature: float = 0.07) -> DataFrame:
    """queries (batch, sample, emb), shots (batch, sample, pos, emb; null: masked), weights (sample, pos, weight) -> batch, n, loss.

    Cross entropy of a query's own shots, by their weights, among all shots of the batch. Weights are made to sum to 1 over
    the shots that aren't masked, and equal where they sum to nothing. Queries without a shot take no part.
    """
    live = shots.where("emb is not null")
    asked = queries.where("emb is not null").join(live.select("batch", "sample").distinct(), ["batch", "sample"], "left_semi")
    own = live.join(weights, ["sample", "pos"], "left").join(asked.select("batch", "sample", F.col("emb").alias("_q")), ["batch", "sample"])
    logit = vx.dot(F.col("_q"), F.col("emb")) / temperature
    sums = own.groupBy("batch", "sample").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("_w"), F.sum(F.coalesce("weight", F.lit(0.0)) * logit).alias("_x"), F.avg(logit).alias("_m"))
    target = sums.select("batch", F.col("sample").alias("id"), F.when(F.col("_w") > 0, F.col("_x") / F.col("_w")).otherwise(F.col("_m")).alias("target"))
    found = log_sums(asked.select("batch", F.col("sample").alias("id"), "emb"), live.select("batch", F.xxhash64("sample", "pos").alias("id"), "emb"), temperature)
    return found.join(target, ["batch", "id"]).groupBy("batch").agg(F.count("*").alias("n"), F.avg(F.col("log_sum") - F.col("target")).alias("loss"))


def consistency_loss(rows: DataFrame, a: str, b: str, key: str = "batch") -> DataFrame:
    """1 - the mean cosine of two vectors over a key's rows that have both -> key, loss; a key without such rows has 1."""
    cosine = vx.dot(F.col(a), F.col(b)) / F.greatest(vx.norm(F.col(a)) * vx.norm(F.col(b)), F.lit(1e-8))
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return rows.groupBy(key).agg((1 - F.coalesce(F.avg(F.when(both, cosine)), F.lit(0.0))).alias("loss"))


def weighted_summary(shots: DataFrame, weights: DataFrame) -> DataFrame:
    """shots (sample, pos, emb), weights (sample, pos, weight) -> sample, summary: the sum of a sample's vectors by weight."""
    each = shots.where("emb is not null").join(weights, ["sample", "pos"])
    items = F.array_sort(F.collect_list(F.struct("pos", F.col("weight").alias("w"), F.transform("emb", lambda x: x.cast("double")).alias("v"))))
    listed = each.groupBy("sample").agg(items.alias("_i"))
    zero = F.transform(F.col("_i")[0]["v"], lambda x: x * 0)
    return listed.select("sample", F.aggregate("_i", zero, lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + x["w"] * q)).alias("summary"))
