"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bpe import op10_byte_bpe
from .cap_filters import OP5_SQL, op5_cap_filters
from .chat import OP9_SQL, op9_chat_template
from .language import op1_crf_language
from .line_dedup import OP2_SQL, op2_line_runs
from .mixing import MIX_TARGETS_SQL, mix_targets, op3_entropy_mix
from .ngram_join import OP4_SQL, op4_partenum
from .quality import BASE_RULES_SQL, base_rules, op6_ngram_ratio
from .sharding import op7_minimax_shards
from .toxicity import op8_subsequence_svm

QUERIES = {
    "op1_crf_language": op1_crf_language,
    "op2_line_runs": op2_line_runs,
    "op10_byte_bpe": op10_byte_bpe,
    "op3_entropy_mix": op3_entropy_mix,
    "op4_partenum": op4_partenum,
    "op5_cap_filters": op5_cap_filters,
    "op6_ngram_ratio": op6_ngram_ratio,
    "op7_minimax_shards": op7_minimax_shards,
    "op8_subsequence_svm": op8_subsequence_svm,
    "op9_chat_template": op9_chat_template,
    "mix_targets": mix_targets,
    "base_rules": base_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_runs": OP2_SQL,
    "op4_partenum": OP4_SQL,
    "op5_cap_filters": OP5_SQL,
    "op9_chat_template": OP9_SQL,
    "mix_targets": MIX_TARGETS_SQL,
    "base_rules": BASE_RULES_SQL,
}
