"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloomlm, embdedup, htmltext, laesa, langid, mixing, packing, simhash, spelling, suffixdedup, treebpe, urlfilter, vptree

#: name: (module, table)
OPERATORS = {
    "op1_lm_scoring": (bloomlm, "documents"),
    "op2_packing": (packing, "documents"),
    "op3_url_filters": (urlfilter, "pages"),
    "op4_vp_tree_search": (vptree, "embeddings"),
    "op5_html_extraction": (htmltext, "pages"),
    "op6_simhash_dedup": (simhash, "documents"),
    "op7_embedding_dedup": (embdedup, "embeddings"),
    "op8_language_id": (langid, "documents"),
    "op9_suffix_array_dedup": (suffixdedup, "documents"),
    "op10_mixing": (mixing, "documents"),
    "op11_spelling_variants": (spelling, "documents"),
    "op12_centroid_clustering": (laesa, "embeddings"),
    "op13_tree_bpe": (treebpe, "documents"),
}


def _over(module, table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: module.query(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _over(*of) for name, of in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, (module, _) in OPERATORS.items() if hasattr(module, "SQL")}
