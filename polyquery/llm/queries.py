"""Queries of this subpackage, for the entry module."""

from __future__ import annotations

from polyquery.llm import cover_search, fingerprints, lm_score, mixing, near_dedup, packing, pii, quality, secrets, token_counts

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_quality": quality.op2_quality,
    "op3_pii": pii.op3_pii,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_cover_search": cover_search.op5_cover_search,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_secrets": secrets.op10_secrets,
}
ORACLE_SQL: dict[str, str] = {"op5_cover_search": cover_search.SQL, "op9_near_dedup": near_dedup.SQL}
