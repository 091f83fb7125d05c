"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm.bpe import op12_bpe_codec
from tidemark.llm.conversations import OP11_SQL, op11_conversation_repair
from tidemark.llm.decontamination import op10_decontamination
from tidemark.llm.html_text import op7_html_extraction
from tidemark.llm.importance import OP13_SQL, op13_importance_resampling
from tidemark.llm.near_dedup import OP5_SQL, op5_minhash_near_dedup
from tidemark.llm.packing import op2_best_fit_packing
from tidemark.llm.pii import op9_personal_data
from tidemark.llm.quality import OP4_SQL, op4_quality_rules
from tidemark.llm.secrets import op8_secret_scan
from tidemark.llm.suffix_dedup import OP1_SQL, op1_suffix_dedup
from tidemark.llm.tokens import op6_token_counts
from tidemark.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_secret_scan": op8_secret_scan,
    "op9_personal_data": op9_personal_data,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": OP1_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
}
