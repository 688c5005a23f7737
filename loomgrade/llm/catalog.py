"""The subpackage's queries by name, and their SQL where it can say the same."""

from __future__ import annotations

from loomgrade.llm import bpe, chat, decontamination, importance, language_id, language_model, line_dedup, simhash, structure_repair, token_counts, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.query,
        "op2_url_filters": url_filter.query,
        "op3_token_counts": token_counts.query,
        "op4_simhash": simhash.query,
        "op5_lm_scoring": language_model.query,
        "op6_bpe": bpe.query,
        "op7_toxicity": toxicity.query,
        "op8_line_dedup": line_dedup.query,
        "op9_exact_topk": topk.query,
        "op10_chat_formatting": chat.query,
        "op11_importance_resampling": importance.query,
        "op12_language_id": language_id.query,
        "op13_structure_repair": structure_repair.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.SQL,
        "op2_url_filters": url_filter.SQL,
        "op3_token_counts": token_counts.SQL,
        "op8_line_dedup": line_dedup.SQL,
        "op9_exact_topk": topk.SQL,
        "op10_chat_formatting": chat.SQL,
        "op11_importance_resampling": importance.SQL,
        "op13_structure_repair": structure_repair.SQL,
    }
