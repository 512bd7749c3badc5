"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, language_id, lm_scoring, near_dedup, packing, ranking, secrets, sharding, substring_dedup, suffix_dedup, top_k, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_top_k": top_k.op5_top_k,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_secrets": secrets.op7_secrets,
    "op8_packing": packing.op8_packing,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_alignment": alignment.op11_alignment,
    "op12_ranking": ranking.op12_ranking,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op4_sharding": sharding.ORACLE,
    "op5_top_k": top_k.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op12_ranking": ranking.ORACLE,
}
