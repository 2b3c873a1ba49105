"""The pipeline's stages one by one and together."""

import collections
import random

import numpy as np

import corpus_pipeline
from quern.llm import mixing, suffixdedup
from test_near_dedup import plain_kept

SF = "/root/testdata/sf0.001"


def plain_removed(docs, span):
    """Each document's bytes, and how many of them a repeated string of `span` bytes covers."""
    starts = collections.Counter()
    texts = [(r["text"] or "").encode() for r in docs]
    for t in texts:
        starts.update(hash(t[i : i + span]) for i in range(len(t) - span + 1))
    for r, t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if starts[hash(t[i : i + span])] > 1:
                gone[i : i + span] = True
        yield {"doc_id": r["doc_id"], "n_bytes": len(t), "n_removed": int(gone.sum()), "kept": bytes(np.frombuffer(t, np.uint8)[~gone])}


def test_passages_of_51_words_go_and_clean_documents_stay(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.choice((2, 3, 4, 5, 6, 8))))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(51) for _ in range(12)]
    rows = [(i, f"{text(200)} {passages[i % 12]} {text(150)}") for i in range(36)] + [(100 + i, text(300)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, score double")
    found = {r["doc_id"]: r for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    assert corpus_pipeline.remove_repeats(spark, docs, "").columns == docs.columns
    for i, t in rows:
        if i < 100:
            assert passages[i % 12][4:-4] not in found[i]["text"] and len(found[i]["text"]) < len(t) - 200
        else:
            assert found[i]["text"] == t


def test_language_stage_keeps_columns_of_any_name(spark):
    rows = [(i, f"some words of a text {i}", "en", "s", 0, 0.25, "mine") for i in range(6)] + [(9, "12 !", "en", "s", 0, 0.5, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")
    found = corpus_pipeline.keep_identified(spark, docs, "")
    assert found.columns == docs.columns
    assert {(r["doc_id"], r["score"], r["lang_pred"]) for r in found.collect()} == {(i, 0.25, "mine") for i in range(6)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(-1, None, "en", "src1", None), (-2, "!? 12", "en", "src1", 5), (-3, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(junk)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "SimHash near-dedup", "suffix-array dedup", "mixing sources", "packing"]
    identified, unique, cut, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    a = identified(spark, docs, SF)
    assert a.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in a.collect()} == {-1, -2, -3}
    b = unique(spark, a, SF)
    assert b.columns == docs.columns
    assert {r["doc_id"] for r in b.collect()} == plain_kept([(r["doc_id"], r["text"]) for r in a.collect()])
    c = cut(spark, b, SF).cache()
    known = suffixdedup.SHORT  # the stage's span; op9's own is its contract's
    told = {r["doc_id"]: r for r in plain_removed(b.collect(), known)}
    assert {r["doc_id"] for r in c.collect()} == {i for i, r in told.items() if r["n_removed"] < r["n_bytes"]}
    assert all(r["text"].encode() == told[r["doc_id"]]["kept"].decode("utf-8", "ignore").encode() for r in c.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in c.collect() if told[r["doc_id"]]["n_removed"])
    d = mixed(spark, c, SF).cache()
    sizes = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.query(c).collect()}
    assert collections.Counter(r["doc_id"] for r in d.collect()) == collections.Counter(sizes)
    e = packed(spark, d, SF).collect()
    texts = collections.Counter()
    for r in e:
        texts[r["doc_id"]] += r["length"]
    assert set(texts) == {r["doc_id"] for r in d.collect()} and len({r["sequence_id"] for r in e}) == len(e)
    assert all(int(np.log2(r["length"])) == np.log2(r["length"]) for r in e)


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
