"""Queries of this package, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from lamella.llm.chain_dedup import op2_chain_dedup
from lamella.llm.decontaminate import op9_decontaminate
from lamella.llm.html_extract import op5_html_extraction
from lamella.llm.language_id import op7_language_id
from lamella.llm.line_dedup import OP1_SQL, op1_line_dedup
from lamella.llm.near_dedup import op4_minhash_dedup
from lamella.llm.pattern_packing import op6_pattern_packing
from lamella.llm.progressive_jpeg import op3_progressive_jpeg
from lamella.llm.suffix_dedup import op10_suffix_dedup
from lamella.llm.token_output import op8_token_output


def queries() -> dict:
    found = [op1_line_dedup, op2_chain_dedup, op3_progressive_jpeg, op4_minhash_dedup, op5_html_extraction, op6_pattern_packing, op7_language_id, op8_token_output, op9_decontaminate, op10_suffix_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL}
