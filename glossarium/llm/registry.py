"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossarium.llm import op1_compression_bands, op2_reshard, op3_toxicity, op4_quality, op5_chunk_recipes, op6_suffix_array, op7_packing, op8_line_dedup, op9_byte_bpe, op10_jaccard_join, op11_lexical_search, op12_sentencepiece, op13_merkle_manifest


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_compression_bands": op1_compression_bands.query,
        "op2_min_cost_reshard": op2_reshard.query,
        "op3_subword_toxicity": op3_toxicity.query,
        "op4_subword_quality": op4_quality.query,
        "op5_chunk_recipes": op5_chunk_recipes.query,
        "op6_suffix_array_dedup": op6_suffix_array.query,
        "op7_sum_of_squares_packing": op7_packing.query,
        "op8_bloom_line_dedup": op8_line_dedup.query,
        "op9_byte_bpe": op9_byte_bpe.query,
        "op10_jaccard_voronoi_join": op10_jaccard_join.query,
        "op11_lexical_search": op11_lexical_search.query,
        "op12_sentencepiece": op12_sentencepiece.query,
        "op13_merkle_manifest": op13_merkle_manifest.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chunk_recipes": op5_chunk_recipes.ORACLE_SQL,
        "op8_bloom_line_dedup": op8_line_dedup.ORACLE_SQL,
        "op11_lexical_search": op11_lexical_search.ORACLE_SQL,
        "op13_merkle_manifest": op13_merkle_manifest.ORACLE_SQL,
    }
