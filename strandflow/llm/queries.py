"""The queries of the training-data operators, with DuckDB's SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import decontamination, language_id, licenses, mixing, mpeg_audio, near_dedup, secrets_scan, sharding, substring_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.query,
        "op2_mixing": mixing.query,
        "op3_mpeg_audio": mpeg_audio.query,
        "op4_decontamination": decontamination.query,
        "op5_sharding": sharding.query,
        "op6_substring_dedup": substring_dedup.query,
        "op7_token_counts": token_counts.query,
        "op8_secrets": secrets_scan.query,
        "op9_near_dedup": near_dedup.query,
        "op10_licenses": licenses.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.SQL,
        "op4_decontamination": decontamination.SQL,
        "op6_substring_dedup": substring_dedup.SQL,
        "op8_secrets": secrets_scan.sql(),
        "op10_licenses": licenses.SQL,
    }
