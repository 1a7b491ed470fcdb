"""The operators' queries over whole tables, by registry name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, licences, mixing, neardup, packing, pii, quality, sharding, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nnpu_toxicity": toxicity.query,
        "op2_suffix_array_decontamination": decontam.query,
        "op3_context_mixing": mixing.query,
        "op4_weak_supervision_pii": pii.query,
        "op5_licence_classifier": licences.query,
        "op6_boosted_quality": quality.query,
        "op7_warc_zstd": warc.query,
        "op8_lpt_sharding": sharding.query,
        "op9_best_fit_packing": packing.query,
        "op10_order_minhash": neardup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_decontamination": decontam.SQL, "op7_warc_zstd": warc.SQL}
