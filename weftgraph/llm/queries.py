"""The registered queries of the text operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, chat, licences, mixing, near_dedup, quality, simhash, sql, tokens, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_chat_format": chat.op3_chat_format,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_url_filter": urls.op5_url_filter,
        "op6_mix": mixing.op6_mix,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_licences": licences.op8_licences,
        "op9_fingerprints": simhash.op9_fingerprints,
        "op10_bpe": bpe.op10_bpe,
        "pipeline": corpus_pipeline.run,
    } | sql.queries()


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
