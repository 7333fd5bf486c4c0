"""Queries of the subpackage by name, and DuckDB SQL where SQL can express them."""

from . import archive, decontaminate, edits, language, lines, packing, passages, secrets, simhash, topk

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_token_archives": archive.op2_token_archives,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_substring_dedup": passages.op7_substring_dedup,
    "op8_token_counts": edits.op8_token_counts,
    "op9_packing": packing.op9_packing,
    "op10_decontamination": decontaminate.op10_decontamination,
}
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": lines.OP3_SQL,
    "op5_exact_topk": topk.OP5_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
}
