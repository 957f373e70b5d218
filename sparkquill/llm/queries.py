"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, line_dedup, media, mixing, near_dup, pii, secrets, substring_dedup, token_coder, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_token_coder": token_coder.op2_token_coder,
    "op3_media_columns": media.op3_media_columns,
    "op4_near_dup": near_dup.op4_near_dup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_secrets": secrets.op6_secrets,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_pii": pii.op8_pii,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mixing": mixing.op10_mixing,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.SQL1,
    "op4_near_dup": near_dup.SQL4,
    "op5_decontaminate": decontaminate.SQL5,
    "op6_secrets": secrets.SQL6,
    "op9_line_dedup": line_dedup.SQL9,
    "op10_mixing": mixing.SQL10,
}
