"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, contamination, lines, media, mixing, neardup, secrets, suffixes, token_files, toxicity

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_minhash_near_dedup": neardup.op2_minhash_near_dedup,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_suffix_array_dedup": suffixes.op5_suffix_array_dedup,
    "op6_benchmark_decontamination": contamination.op6_benchmark_decontamination,
    "op7_token_counts": token_files.op7_token_counts,
    "op8_media_columns": media.op8_media_columns,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {
    "op1_line_dedup": lines.OP1_SQL,
    "op2_minhash_near_dedup": neardup.OP2_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op6_benchmark_decontamination": contamination.OP6_SQL,
}
