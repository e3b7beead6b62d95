"""The queries of this subpackage and, where SQL can express them, their DuckDB form."""

from __future__ import annotations

from . import chat, decontam, fixity
from .chat import op3_prefix_target_expansion
from .decontam import op10_wu_manber_decontamination
from .factorization import op1_factorization_quality
from .fixity import op7_merkle_fixity
from .katz import op8_katz_backoff
from .mixing import op4_mixing
from .near_dup import op9_minhash_near_dedup
from .passages import op6_fuzzy_passages
from .rules import op2_boosted_quality_rules
from .toxicity import op5_toxicity_ordinal

QUERIES = {f.__name__: f for f in (op1_factorization_quality, op2_boosted_quality_rules, op3_prefix_target_expansion, op4_mixing, op5_toxicity_ordinal, op6_fuzzy_passages, op7_merkle_fixity, op8_katz_backoff, op9_minhash_near_dedup, op10_wu_manber_decontamination)}
ORACLE_SQL = {"op3_prefix_target_expansion": chat.SQL, "op7_merkle_fixity": fixity.SQL, "op10_wu_manber_decontamination": decontam.SQL}
