"""The subpackage's queries, and the reference SQL of those SQL can state."""

from __future__ import annotations

from scriptorium.llm import (
    decontamination,
    fingerprints,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    pii,
    resampling,
    secret_scan,
    token_counts,
    training_order,
    toxicity,
    vector_codes,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_packing": packing.op2_packing,
    "op3_language_id": language_id.op3_language_id,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_training_order": training_order.op5_training_order,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_pii": pii.op13_pii,
}
SQL = {
    "op8_decontamination": decontamination.OP8_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
}
