"""The queries of this package, one for each operator, and the SQL of those that SQL can express."""

from . import chat_format, decontamination, language_id, near_dedup, packing, quality, sharding, substring_dedup, topk, toxicity

QUERIES: dict = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_simhash_near_dedup": near_dedup.op3_simhash_near_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_language_id": language_id.op5_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
    "op10_sharding": sharding.op10_sharding,
}
ORACLES: dict = {
    "op1_exact_topk": topk.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
}
