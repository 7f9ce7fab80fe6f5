"""The queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from .bpe import op7_bpe
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .html_blocks import op6_html
from .mixing import MIXING_TARGETS_SQL, mixing_targets, op3_mixing
from .near_dedup import OP9_SQL, op9_near_dedup
from .pii import PII_BASE_SQL, op4_pii, pii_base_spans
from .quality import op8_quality
from .substrings import OP10_SQL, op10_substrings
from .topk import OP2_SQL, op2_topk
from .toxicity import op5_toxicity

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_topk": op2_topk,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_html": op6_html,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_substrings": op10_substrings,
    "mixing_targets": mixing_targets,
    "pii_base_spans": pii_base_spans,
}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op2_topk": OP2_SQL, "op9_near_dedup": OP9_SQL, "op10_substrings": OP10_SQL, "mixing_targets": MIXING_TARGETS_SQL, "pii_base_spans": PII_BASE_SQL}
