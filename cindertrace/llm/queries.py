"""The corpus queries and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cindertrace.llm import chat, decontamination, filter_audit, neighbours, pages, pieces, ranked_search, recompression, simhash, suffix_dedup, token_counts, token_store, weak_labels


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_substring_dedup": recompression.op2_substring_dedup,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_simhash": simhash.op4_simhash,
        "op5_nearest": neighbours.op5_nearest,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_html_main_text": pages.op7_html_main_text,
        "op8_token_store": token_store.op8_token_store,
        "op9_weak_labels": weak_labels.op9_weak_labels,
        "op10_chat_formatting": chat.op10_chat_formatting,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_ranked_search": ranked_search.op12_ranked_search,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_formatting": chat.OP10_SQL, "op11_filter_audit": filter_audit.OP11_SQL, "op12_ranked_search": ranked_search.OP12_SQL}
