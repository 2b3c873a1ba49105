"""Losses, dense ordinals, index scans and several models against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import search, training
from quern.sources import ordinals


def vectors(rng, n, d=6):
    return rng.normal(size=(n, d)) / 3


def test_contrastive_loss_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK", 4)
    rng = np.random.default_rng(1)
    want, rows, items = {}, [], []
    for batch, n in (("a", 23), ("b", 1), (None, 3)):
        q, i = vectors(rng, n), vectors(rng, n)
        s = q @ i.T / 0.07
        lse = lambda x: np.log(np.exp(x - x.max()).sum()) + x.max()
        if batch:
            want[batch] = (n, np.mean([0.5 * (lse(s[k]) + lse(s[:, k])) - s[k, k] for k in range(n)]))
        rows += [(batch, k, v.tolist()) for k, v in enumerate(q)]
        items += [(batch, k, v.tolist()) for k, v in enumerate(i)]
    rows.append(("a", 99, None))
    items.append(("b", 77, [0.0] * 6))
    schema = "batch string, id long, emb array<double>"
    got = {r["batch"]: (r["n"], r["loss"]) for r in training.contrastive_loss(spark.createDataFrame(rows, schema), spark.createDataFrame(items, schema)).collect()}
    assert got == {b: (n, pytest.approx(x)) for b, (n, x) in want.items()}


def test_logits_of_any_size(spark):
    """Exponentials are taken against the largest logit."""
    df = spark.createDataFrame([("a", k, [1000.0 * k, 0.0]) for k in range(3)], "batch string, id long, emb array<double>")
    assert training.contrastive_loss(df, df, 1.0).first()["loss"] == pytest.approx((0.5 * np.log(3) + 1e6 / 2 + 1e6 / 2) / 3, rel=1e-6)


def test_shot_loss(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK", 3)
    rng = np.random.default_rng(2)
    q, shots, weights = vectors(rng, 9), [], {}
    for k in range(9):
        for p in range(k % 4):
            shots.append((0, k, p, None if (k + p) % 4 == 0 else vectors(rng, 1)[0].tolist()))
            weights[k, p] = 0.0 if k == 3 else float(rng.random())
    live = [(k, p, np.array(v)) for _, k, p, v in shots if v is not None]
    losses = []
    for k in sorted({k for k, _, _ in live}):
        s = np.array([q[k] @ v for _, _, v in live]) / 0.5
        log_p = s - np.log(np.exp(s).sum())
        w = np.array([weights[k, p] if k == j else 0.0 for j, p, _ in live])
        w = w / w.sum() if w.sum() else np.array([float(k == j) for j, _, _ in live]) / sum(k == j for j, _, _ in live)
        losses.append(-(w * log_p).sum())
    queries = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(q)], "batch long, sample long, emb array<double>")
    got = training.shot_loss(queries, spark.createDataFrame(shots, "batch long, sample long, pos long, emb array<double>"), spark.createDataFrame([(k, p, w) for (k, p), w in weights.items()], "sample long, pos long, weight double"), 0.5).collect()
    assert [(r["n"], r["loss"]) for r in got] == [(len(losses), pytest.approx(np.mean(losses)))]


def test_soft_positives_of_masked_shots(spark):
    captions = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "sample long, emb array<double>")
    shots = spark.createDataFrame([(1, 0, [1.0, 0.0], 0.0), (1, 1, [1.0, 0.0], 0.0), (1, 2, None, 1.0), (1, 3, [0.0, 1.0], None), (2, 0, None, 1.0)], "sample long, pos long, emb array<double>, overlap double")
    got = {(r["sample"], r["pos"]): r["weight"] for r in training.soft_positives(captions, shots).collect()}
    low = np.exp(-0.8 / 0.07)
    assert got == {(1, 0): pytest.approx(1 / (2 + low)), (1, 1): pytest.approx(1 / (2 + low)), (1, 2): 0.0, (1, 3): pytest.approx(low / (2 + low)), (2, 0): 0.0}


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_dense_ordinals(spark, ranges):
    """A key with a third of all rows, nulls and repeats of the first column; numbers without gaps in the global order."""
    rows = [(("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}"), i * 37 % 9001) for i in range(6000)]
    df = spark.createDataFrame(rows, "a string, b long").repartition(7)
    got = {(r["a"], r["b"]): r["index_id"] for r in ordinals.dense_ordinals(df, ["a", "b"], ranges=ranges).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == {r: i for i, r in enumerate(want)}
    assert ordinals.dense_ordinals(df.limit(0), ["a"]).count() == 0


def test_ordinals_leave_no_single_task(spark):
    df = spark.range(100_000).select((F.col("id") % 10).alias("a"), "id")
    out = ordinals.dense_ordinals(df, ["a", "id"], ranges=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    window = next(line for line in plan[plan.index("Window") :].splitlines() if "Exchange" in line)
    assert "hashpartitioning(_range" in window
    placed = out.groupBy(F.spark_partition_id()).count().count()
    assert placed > 1 and out.agg(F.max("index_id")).first()[0] == 99_999


def test_keyframe_index_raises(spark):
    schema = "video string, frames array<long>, embeddings array<array<float>>"
    good = spark.createDataFrame([("b", [5, 1], [[3.0, 4.0], [0.0, 2.0]]), ("a", [7], [[1.0, 0.0]])], schema)
    got = [(r["index_id"], r["video"], r["frame"], [round(x, 5) for x in r["emb"]]) for r in ordinals.keyframe_index(good).orderBy("index_id").collect()]
    assert got == [(0, "a", 7, [1.0, 0.0]), (1, "b", 1, [0.0, 1.0]), (2, "b", 5, [0.6, 0.8])]
    for bad in (("c", [1, 2], [[1.0, 0.0]]), ("", [1], [[1.0, 0.0]]), ("d", [1], None)):
        with pytest.raises(Exception, match="differ in number|without a video"):
            ordinals.keyframe_index(spark.createDataFrame([bad], schema)).collect()


def test_models_in_one_scan(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(-2, 3, (2500, 3)).astype(float), rng.integers(-2, 3, (2500, 2)).astype(float)
    rows = [(i, None if i % 4 == 1 else a[i].tolist(), None if i % 3 == 0 else b[i].tolist()) for i in range(2500)]
    asked = [(q, m, v.tolist()) for q in range(5) for m, v in (("a", rng.normal(size=3).round(1)), ("b", rng.normal(size=2).round(1)))] + [(9, "c", [1.0])]
    found = search.model_knn(spark.createDataFrame(rows, "item_id long, a array<double>, b array<double>"), spark.createDataFrame(asked, "query_id long, model string, emb array<double>"), ["a", "b"], 7)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r["query_id"], r["channel"], r["rank"]): r["item_id"] for r in found.collect()}
    for q, m, v in asked[:-1]:
        scores = sorted((-(np.array(r[1 + (m == "b")]) @ np.array(v)), r[0]) for r in rows if r[1 + (m == "b")] is not None)
        assert [got[q, m, k + 1] for k in range(7)] == [i for _, i in sorted((round(s, 12), i) for s, i in scores)[:7]]
    assert len(got) == 70
    one = search.model_fusion(found.where("channel = 'a'"), ["a"], 3).where("query_id = 0").orderBy("rank").collect()
    assert [r["item_id"] for r in one] == [got[0, "a", k] for k in (1, 2, 3)]
