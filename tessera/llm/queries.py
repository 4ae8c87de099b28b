"""The queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from . import chat, decontam, exact_dedup, langid, near_dedup, packing, quality, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_quality": quality.op2_quality,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_pack": packing.op7_pack,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_chat_format": chat.op9_chat_format,
    "op10_url_filter": url_filter.op10_url_filter,
}

SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}
