"""Corpus pipeline: stages that each apply one operator of quern.llm to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, mixing, packing, simhash, suffixdedup
from quern.llm._common import materialise


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from all labelled documents of the stage's input; those it rejects (und: no letters) go."""
    columns = docs.columns
    whole = docs.select(F.struct(*columns).alias("_row"), "text")  # columns of any name pass
    told = langid.identify(whole, langid.learn_documents(docs), ("_row",))
    return told.where("lang_pred <> 'und'").select(*(F.col("_row")[c].alias(c) for c in columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash candidates, then five-word shingles at similarity 0.8 by exact comparison; op6's contract (three words, radius 2) binds its query alone."""
    return simhash.deduplicate_similar(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat go: SHORT bytes, not op9's 400, as 51 words can have 250 bytes."""
    return suffixdedup.remove_repeats(docs, suffixdedup.SHORT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_identified),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("mixing sources", mix_sources),
    ("packing", pack),
]
#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
