"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, embedding_dedup, importance_resampling, jaccard_join, lexical_search, license_scan, line_dedup, mixing, oracles, quality_model, quality_rules, substring_dedup, token_store, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_warc": warc.op4_warc,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_token_store": token_store.op7_token_store,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}
ORACLES = {
    "op1_substring_dedup": oracles.OP1_SQL,
    "op3_embedding_dedup": oracles.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_jaccard_join": oracles.OP8_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_license_scan": license_scan.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_importance_resampling": importance_resampling.OP13_SQL,
}
