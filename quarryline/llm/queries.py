"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, filter_audit, jaccard_join, language_id, license_scan, line_dedup, packing, quality_crf, quality_rules, source_mixing, substring_dedup, url_filter, vector_codes

QUERIES = {
    "op1_quality_classifier": quality_crf.op1,
    "op2_language_id": language_id.op2,
    "op3_best_fit_packing": packing.op3,
    "op4_license_scan": license_scan.op4,
    "op5_quality_rules": quality_rules.op5,
    "op5_rule_ablation": quality_rules.op5_ablation,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_url_filter": url_filter.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_source_mixing": source_mixing.op12,
    "op13_vector_codes": vector_codes.op13,
}

SQL: dict[str, str] = {
    "op5_quality_rules": quality_rules.SQL,
    "op5_rule_ablation": quality_rules.SQL_ABLATION,
    "op6_substring_dedup": substring_dedup.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
