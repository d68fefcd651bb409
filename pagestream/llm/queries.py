"""The queries of this subpackage: one per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagestream.llm import bpe_table, html_blocks, jaccard_join, line_dedup, nn_descent, packing, quality, suffix_dedup, toxicity, url_reputation
from pagestream.llm.sql import oracle_sql as oracle_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: _table(s, d, "documents")
    return {
        "op1_html_blocks": lambda s, d: html_blocks.extract(_table(s, d, "pages")),
        "op2_nn_descent": lambda s, d: nn_descent.nearest(_table(s, d, "embeddings")),
        "op3_packing": lambda s, d: packing.pack(docs(s, d)),
        "op4_suffix_dedup": lambda s, d: suffix_dedup.suffix_dedup(docs(s, d)),
        "op5_quality_divergence": lambda s, d: quality.judge(docs(s, d)).drop("char_distance", "word_distance"),
        "op6_toxicity_lexicon": lambda s, d: toxicity.score(docs(s, d), _table(s, d, "labels")),
        "op7_url_reputation": lambda s, d: url_reputation.judge(_table(s, d, "pages"), _table(s, d, "labels")).drop("rate", "lower"),
        "op8_line_dedup": lambda s, d: line_dedup.line_dedup(docs(s, d)),
        "op9_bpe_table": lambda s, d: bpe_table.encode_digest(docs(s, d)),
        "op10_jaccard_join": lambda s, d: jaccard_join.jaccard_components(docs(s, d)),
    }
