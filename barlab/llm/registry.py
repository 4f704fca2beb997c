"""Queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    bpe, exact_dedup, html_extract, importance, jaccard_join, lang_id, license_scan, line_quality, mixing, piece_bpe, suffix_dedup,
    token_alignment, token_files,
)


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_jaccard_join": jaccard_join.op2_jaccard_join,
        "op3_line_quality": line_quality.op3_line_quality,
        "op3_line_limit": line_quality.op3_line_limit,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_source_mix": mixing.op6_source_mix,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_language_id": lang_id.op8_language_id,
        "op9_html_main_text": html_extract.op9_html_main_text,
        "op10_token_files": token_files.op10_token_files,
        "op11_piece_bpe": piece_bpe.op11_piece_bpe,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_importance": importance.op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE, "op3_line_quality": line_quality.ORACLE, "op3_line_limit": line_quality.ORACLE_LIMIT,
        "op6_source_mix": mixing.ORACLE, "op13_importance": importance.ORACLE,
    }
