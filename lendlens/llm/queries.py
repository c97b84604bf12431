"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, dialogue, html_text, line_dedup, minhash, pii, quality, sharding, sp_codec, suffix_dedup, token_files, url_filter, whitening


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_pii": pii.op2_pii,
        "op3_html_text": html_text.op3_html_text,
        "op4_sentencepiece": sp_codec.op4_sentencepiece,
        "op5_token_files": token_files.op5_token_files,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        # the long passages that this key was registered for are now part of op7_line_dedup
        "op7_long_line_dedup": line_dedup.op7_line_dedup,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_decontamination": decontam.op10_decontamination,
        "op10_proximity": decontam.op10_proximity,
        "op11_sharding": sharding.op11_sharding,
        "op12_conversation_repair": dialogue.op12_conversation_repair,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_queries() -> dict[str, str]:
    return {
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op7_long_line_dedup": line_dedup.OP7_SQL,
        "op10_decontamination": decontam.OP10_SQL,
        "op10_proximity": decontam.OP10_NEAR_SQL,
        "op12_conversation_repair": dialogue.OP12_SQL,
    }
