"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from chatloom.llm.bpe_codec import op12_bpe_round_trip
from chatloom.llm.decontamination import op9_decontamination
from chatloom.llm.importance import op13_importance_resampling
from chatloom.llm.language_id import op3_language_id
from chatloom.llm.license_scan import OP4_SQL, op4_license_scan
from chatloom.llm.packing import op1_packing
from chatloom.llm.pitman_yor import op6_language_model
from chatloom.llm.quality_classifier import op8_quality_classifier
from chatloom.llm.quality_rules import OP5_SQL, op5_quality_rules
from chatloom.llm.simhash import op10_simhash
from chatloom.llm.spelling import op11_spelling_variants
from chatloom.llm.token_counts import OP2_SQL, op2_token_counts
from chatloom.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_model": op6_language_model,
    "op7_toxicity": op7_toxicity,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {"op2_token_counts": OP2_SQL, "op4_license_scan": OP4_SQL, "op5_quality_rules": OP5_SQL}
