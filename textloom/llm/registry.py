"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, collocations, embedding_dedup, importance, language_id, line_dedup, merkle, mixing, order_minhash, prefix_tokens, secret_scan, substring_dedup, syncmers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_importance": importance.op4_importance,
        "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
        "op6_near_dedup": order_minhash.op6_near_dedup,
        "op7_syncmers": syncmers.op7_syncmers,
        "op8_language_id": language_id.op8_language_id,
        "op9_mixing": mixing.op9_mixing,
        "op10_bpe": bpe.op10_bpe,
        "op11_manifest": merkle.op11_manifest,
        "op12_token_counts": prefix_tokens.op12_token_counts,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op11_manifest": merkle.ORACLE_SQL,
        "op13_collocations": collocations.ORACLE_SQL,
    }
