"""The subpackage's queries and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from . import bits, exact, language, near, packing, pieces, pii, secrets, toxicity, winnow

QUERIES = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_near_duplicates": near.op2_near_duplicates,
    "op3_secrets": secrets.op3_secrets,
    "op4_language": language.op4_language,
    "op5_token_output": bits.op5_token_output,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_pii": pii.op7_pii,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_fingerprints": winnow.op10_fingerprints,
}

SQL = {
    "op1_exact_dedup": exact.OP1_SQL,
    "op2_near_duplicates": near.OP2_SQL,
}
