"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from .bpe import op7_bpe_round_trip
from .cover_dedup import op6_cover_dedup
from .fingerprints import op3_fingerprints
from .licenses import op2_license_scan
from .near_dedup import op4_near_duplicates
from .oracle import ORACLE_SQL  # noqa: F401
from .packing import op9_sum_of_squares_packing
from .quality import op1_quality_cotraining
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op10_token_counts
from .topk import op8_exact_topk

QUERIES = {f.__name__: f for f in (op1_quality_cotraining, op2_license_scan, op3_fingerprints, op4_near_duplicates, op5_suffix_dedup, op6_cover_dedup, op7_bpe_round_trip, op8_exact_topk, op9_sum_of_squares_packing, op10_token_counts)}
