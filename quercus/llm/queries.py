"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, hard_negatives
from .alignment import op13_alignment
from .decontamination import op11_decontamination
from .embedding_dedup import op5_embedding_dedup
from .fingerprints import op7_fingerprints
from .hard_negatives import op12_hard_negatives
from .html_text import op4_html_text
from .licenses import op2_licenses
from .mixing import op3_mixing
from .near_dedup import op6_near_dedup
from .packing import op8_packing
from .sharding import op1_sharding
from .token_store import op10_token_store
from .toxicity import op9_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_html_text": op4_html_text,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_token_store": op10_token_store,
    "op11_decontamination": op11_decontamination,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {"op11_decontamination": decontamination.SQL, "op12_hard_negatives": hard_negatives.SQL}
