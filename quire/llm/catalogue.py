"""The queries op1 to op13 and pipeline, and their DuckDB oracles."""

from __future__ import annotations

from quire.llm import chat_format, decontaminate, filter_audit, html_text, importance, jaccard_join, langid, packing, pattern_packing, quality, substring_dedup, token_counts, url_filter


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline  # at the repository's top; it imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_url_filters": url_filter.op1_url_filters,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_language_id": langid.op4_language_id,
        "op5_packing": packing.op5_packing,
        "op6_chat_preference": chat_format.op6_chat_preference,
        "op7_html_text": html_text.op7_html_text,
        "op8_ngram_jaccard": jaccard_join.op8_ngram_jaccard,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_pattern_packing": pattern_packing.op12_pattern_packing,
        "op13_importance": importance.op13_importance,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    own = {"op1_url_filters": url_filter, "op2_quality_rules": quality, "op6_chat_preference": chat_format, "op11_filter_audit": filter_audit, "op13_importance": importance}
    return {name: module.SQL for name, module in own.items()}
