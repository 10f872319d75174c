"""Queries and DuckDB SQL of this subpackage, by registered name."""

from __future__ import annotations

from . import (chat_format, decontaminate, fingerprints, lexical_search, lm_scoring, ngram_join, periodic_runs, personal_data,
               quality_rules, sentence_pieces, token_counts, toxicity, url_filters)

QUERIES = {
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op10_personal_data": personal_data.op10_personal_data,
    "op9_toxicity": toxicity.op9_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op1_sentence_pieces": sentence_pieces.op1_sentence_pieces,
    "op6_token_counts": token_counts.op6_token_counts,
    "op8_chat_format": chat_format.op8_chat_format,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op7_url_filters": url_filters.op7_url_filters,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {
    "op4_decontaminate": decontaminate.SQL,
    "op8_chat_format": chat_format.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op7_url_filters": url_filters.SQL,
    "op12_lexical_search": lexical_search.SQL,
}
