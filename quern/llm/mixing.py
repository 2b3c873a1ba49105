"""Mixing sources to target weights.

Tokens are summed by source, targets follow from the weights, and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy
with probability rate - floor(rate).

A source of few, unequal documents can stray far from its target under one
seed. So each source has its own: of SEEDS seeds the one under which the words
it emits come nearest its target.

Defined results: a null text has size 0; null sources are one source; a
source without words has target 0 and emits nothing; an empty table gives an
empty mix; rows that repeat an id share that id's draw; of two seeds that come
equally near the smaller is taken; columns of any name pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, small

WORD = r"[^\x20\x09-\x0D]+"
HASHES = 16  # hashes of an id, of which each gives four draws of 32 bits
SEEDS = 4 * HASHES


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """sizes (source, source_size), one row a source -> with target and rate.

    Weights are 1, 2, ..., cycle, repeating, by code point with null last.
    Target: min(cap * size, level * weight). The level that spends the whole
    total is the largest (S - cap * capped sizes) / (weights left) over the
    prefixes of the sources sorted by cap * size / weight, so no loop is
    needed. There is one row a source here, so one task sorts them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    size = F.col("source_size").cast("double")
    return (
        sizes.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))
        .withColumn("ratio", F.lit(cap) * size / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)).cast("double"))
        .withColumn("w_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("w_total", F.sum("weight").over(whole))
        .withColumn("level", (F.col("total") - F.lit(cap) * F.col("before")) / (F.col("w_total") - F.col("w_before")))
        .withColumn("level", F.max("level").over(whole))
        .withColumn("target", F.least(F.lit(cap) * size, F.col("level") * F.col("weight")))
        .withColumn("rate", F.when(size > 0, F.col("target") / size).otherwise(0.0))
        .select("source", "source_size", "target", "rate")
    )


def draw(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    text = F.concat(F.floor(seed / 4).cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), (seed % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_seeds(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """sized (_id, _source, _size) and rates -> rates with seed, the source's own."""
    met = sized.where("_size > 0").join(rates, F.col("_source").eqNullSafe(F.col("source"))).withColumn("part", F.col("rate") - F.floor("rate")).where("part > 0")
    each = met.select("source", "_id", "_size", "part", F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))).alias("h"))
    sums = [F.sum(F.when(draw(F.col("_id"), F.col("h") * 4 + j) < F.col("part"), F.col("_size")).otherwise(0)).alias(f"extra{j}") for j in range(4)]
    totals = each.groupBy("source", "h").agg(*sums).select("source", F.posexplode(F.array(*(f"extra{j}" for j in range(4)))).alias("j", "extra"), "h")
    totals = totals.withColumnRenamed("source", "_s").join(rates, F.col("_s").eqNullSafe(F.col("source")))
    off = F.abs(F.floor("rate") * F.col("source_size") + F.col("extra") - F.col("target"))
    best = totals.groupBy("_s").agg(F.min(F.struct(off.alias("off"), (F.col("h") * 4 + F.col("j")).alias("seed")))["seed"].alias("seed"))
    return rates.join(best, F.col("_s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "rate", F.coalesce("seed", F.lit(0)).alias("seed"))


def repetitions(docs: DataFrame, cycle: int = 3, cap: float = 3.0, keep: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each document: `_row`, the columns in `keep` (all by default), and `_mix` (size, source_size, target, copies)."""
    keep = tuple(docs.columns) if keep is None else keep
    sized = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.struct(*keep).alias("_row"))
    sizes = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    rates = materialise(source_targets(sizes, cycle, cap))  # a row a source
    rates = small(materialise(source_seeds(sized, small(rates))))
    copies = F.floor("rate") + F.when(draw(F.col("_id"), F.col("seed")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    mix = F.struct(F.col("_size").alias("size"), "source_size", "target", copies.cast("int").alias("copies")).alias("_mix")
    return sized.join(rates, F.col("_source").eqNullSafe(F.col("source"))).select("_row", mix)


def mix(docs: DataFrame, cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """The mix itself: documents, each as often as the mix takes it, with their own columns."""
    rows = repetitions(docs, cycle, cap).where("_mix.copies > 0")
    each = rows.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_mix.copies"))).alias("_copy"))
    return each.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    m = F.col("_mix")
    found = repetitions(docs, keep=("doc_id",))
    return found.select(F.col("_row.doc_id").alias("doc_id"), m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["copies"] * m["size"]).cast("long").alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sizes),
ratios AS (SELECT *, 3.0::DOUBLE * source_size::DOUBLE / weight AS ratio FROM weighted),
summed AS (
  SELECT *,
    coalesce(sum(source_size) OVER w, 0)::DOUBLE AS before, coalesce(sum(weight) OVER w, 0)::DOUBLE AS w_before,
    (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS w_total
  FROM ratios WINDOW w AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, max((total - 3.0::DOUBLE * before) / (w_total - w_before)) OVER () AS level FROM summed),
rates AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size::DOUBLE, level * weight) AS target,
    CASE WHEN source_size > 0 THEN least(3.0::DOUBLE * source_size::DOUBLE, level * weight) / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate
  FROM levels),
draws AS (
  SELECT rates.source, h, size, rate - floor(rate) AS part, md5(h::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS m
  FROM (SELECT * FROM sized WHERE size > 0) s JOIN rates ON s.source IS NOT DISTINCT FROM rates.source, range(16) t(h) WHERE rate > floor(rate)),
totals AS (
  SELECT source, 4 * h + j AS seed, sum(CASE WHEN ('0x' || substr(m, 1 + 8 * j::INT, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < part THEN size ELSE 0 END) AS extra
  FROM draws, range(4) u(j) GROUP BY ALL),
seeds AS (SELECT source, arg_min(seed, (abs(floor(rate) * source_size + extra - target), seed)) AS seed FROM (SELECT t.*, rate, source_size, target FROM totals t JOIN rates ON t.source IS NOT DISTINCT FROM rates.source) GROUP BY source)
SELECT doc_id, size, source_size, target,
  ((floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5((seed // 4)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), 1 + 8 * (seed % 4)::INT, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM sized JOIN (SELECT rates.*, coalesce(seed, 0) AS seed FROM rates LEFT JOIN seeds ON rates.source IS NOT DISTINCT FROM seeds.source) r ON sized.source IS NOT DISTINCT FROM r.source
"""
