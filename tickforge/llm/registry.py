"""Queries of this subpackage and the SQL that they can be checked by."""

from __future__ import annotations

import corpus_pipeline
from tickforge.llm import chat, debruijn, decontaminate, jaccard, langid, linededup, packing, pii, quality, substrings


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": jaccard.jaccard_query,
        "op2_chat_formatting": chat.chat_query,
        "op3_suffix_array_dedup": substrings.substring_query,
        "op4_line_dedup": linededup.line_query,
        "op5_best_fit_packing": packing.packing_query,
        "op6_quality_rules": quality.quality_query,
        "op7_substring_dedup": debruijn.debruijn_query,
        "op8_language_id": langid.language_query,
        "op9_benchmark_decontamination": decontaminate.decontamination_query,
        "op10_pii": pii.pii_query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": jaccard.JACCARD_SQL, "op7_substring_dedup": debruijn.DEBRUIJN_SQL, "op2_chat_formatting": chat.CHAT_SQL}
