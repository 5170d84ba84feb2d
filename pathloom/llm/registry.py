"""Queries of the ten operators and of the pipeline, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, html_main, langid, mixing, rules, sharding, simhash, spotsigs, toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.query,
        "op2_toxicity": toxicity.query,
        "op3_mixing": mixing.query,
        "op4_sharding": sharding.query,
        "op5_chat_formatting": chat.query,
        "op6_spotsigs": spotsigs.query,
        "op7_decontamination": decontam.query,
        "op8_html_main_text": html_main.query,
        "op9_simhash": simhash.query,
        "op10_quality_rules": rules.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.sql(), "op4_sharding": sharding.sql(), "op7_decontamination": decontam.sql()}
