"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from weftgraph.llm import binary, compaction, decontam, html, lm, merkle, neardup, packing, quality, urlfilter

QUERIES = {
    "op1_pack": packing.op1_pack,
    "op2_extract_text": html.op2_extract_text,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_merkle_audit": merkle.op4_merkle_audit,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_compaction": compaction.op6_compaction,
    "op7_gru_scores": lm.op7_gru_scores,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_token_files": binary.op10_token_files,
}

ORACLES = {
    "op3_quality_rules": quality.ORACLE,
    "op4_merkle_audit": merkle.ORACLE,
    "op5_decontaminate": decontam.ORACLE,
    "op6_compaction": compaction.ORACLE,
    "op8_url_filter": urlfilter.ORACLE,
    "op9_near_duplicates": neardup.ORACLE,
}
