"""Driver queries of the text operators and their SQL twins."""

from __future__ import annotations

from .bestfit import op3_best_fit_packing
from .binary import op7_token_binary
from .decontam import OP1_SQL, op1_decontaminate
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .lines import OP11_SQL, op11_line_dedup
from .lmscore import OP6_SQL, op6_lm_score
from .merkle import OP13_SQL, op13_merkle_manifest
from .quality import op2_quality
from .resample import OP12_SQL, op12_importance_resampling
from .simhash import op5_simhash_near_dedup
from .suffixes import op8_suffix_array_dedup
from .toxicity import op9_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_token_binary": op7_token_binary,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_line_dedup": op11_line_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL = {
    "op1_decontaminate": OP1_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op6_lm_score": OP6_SQL,
    "op10_warc": OP10_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
