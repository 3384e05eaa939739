"""Queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from hazardframe.llm import (
    arrow_ids,
    bisector,
    brown_lm,
    entropy_mix,
    exact_dedup,
    filter_audit,
    jaccard_join,
    pii_crf,
    quality_ppl,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_pack,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_quality_ppl": quality_ppl.op4_quality_ppl,
    "op5_entropy_mix": entropy_mix.op5_entropy_mix,
    "op6_pii_crf": pii_crf.op6_pii_crf,
    "op7_arrow_ids": arrow_ids.op7_arrow_ids,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_vector_pack": vector_pack.op10_vector_pack,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_bisector_clusters": bisector.op12_bisector_clusters,
    "op13_brown_lm": brown_lm.op13_brown_lm,
}

ORACLE_SQL = {
    "op8_jaccard_join": jaccard_join.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_bisector_clusters": bisector.ORACLE_SQL,
}
