"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import ann, byte_bpe, exact_dedup, line_dedup, mixing, near_dedup, sharding, substring_dedup, token_orc, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_orc": token_orc.op3_token_orc,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_nearest": ann.op9_nearest,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
SQL = {"op2_exact_dedup": exact_dedup.SQL}
