"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from lattica.llm import decontaminate, exact_dedup, html_extract, langid, line_dedup, minhash, mixing, quality, token_counts, token_output

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_langid": langid.op3_langid,
    "op4_token_output": token_output.op4_token_output,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_html": html_extract.op8_html,
    "op9_minhash": minhash.op9_minhash,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
}
