"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .compaction import OP5_SQL, op5_compaction
from .decontamination import op1_decontamination
from .licenses import OP7_SQL, op7_licenses
from .packing import op3_packing
from .pii import op2_pii
from .quality import OP10_SQL, op10_quality
from .resampling import OP11_SQL, op11_resampling
from .simhash import op9_simhash
from .substrings import OP4_SQL, op4_substrings
from .topk import OP13_SQL, op13_topk
from .toxicity import op6_toxicity
from .wavelet import op8_wavelet
from .whitening import op12_whitening

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_substrings": op4_substrings,
    "op5_compaction": op5_compaction,
    "op6_toxicity": op6_toxicity,
    "op7_licenses": op7_licenses,
    "op8_wavelet": op8_wavelet,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_resampling": op11_resampling,
    "op12_whitening": op12_whitening,
    "op13_topk": op13_topk,
}

ORACLE_SQL = {
    "op4_substrings": OP4_SQL,
    "op5_compaction": OP5_SQL,
    "op7_licenses": OP7_SQL,
    "op10_quality": OP10_SQL,
    "op11_resampling": OP11_SQL,
    "op13_topk": OP13_SQL,
}
