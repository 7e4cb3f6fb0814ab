"""Queries of this subpackage and the SQL that checks them, for ``__spark_entry__``."""

from __future__ import annotations

from nearlight.llm import embedding_dedup, filter_audit, language_id, ngram_join, packing, piece_sampling, quality_rules, sharding, substring_dedup, token_counts, turn_repair, url_filter, wavelet

QUERIES = {
    "op1_wavelet_shards": wavelet.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_url_filter": url_filter.query,
    "op4_best_fit_packing": packing.query,
    "op5_embedding_dedup": embedding_dedup.query,
    "op6_piece_sampling": piece_sampling.query,
    "op7_ngram_join": ngram_join.query,
    "op8_token_counts": token_counts.query,
    "op9_quality_rules": quality_rules.query,
    "op10_sharding": sharding.query,
    "op11_filter_audit": filter_audit.query,
    "op12_turn_repair": turn_repair.query,
    "op13_language_id": language_id.query,
}
ORACLE = {
    "op5_embedding_dedup": embedding_dedup.ORACLE,
    "op8_token_counts": token_counts.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_turn_repair": turn_repair.ORACLE,
}
