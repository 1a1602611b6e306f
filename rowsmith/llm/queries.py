"""The queries of this package and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from . import decontamination, fingerprints, html_content, jaccard_join, lang_id, mixing, packing, periodic_runs
from . import quality, secret_scan, sharding, token_alignment, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_quality": quality.op2_quality,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sharding": sharding.op5_sharding,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_mixing": mixing.op7_mixing,
    "op8_html": html_content.op8_html,
    "op9_lang_id": lang_id.op9_lang_id,
    "op10_secrets": secret_scan.op10_secrets,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_packing": packing.op13_packing,
}
ORACLE = {"op6_jaccard_join": jaccard_join.OP6_SQL, "op7_mixing": mixing.OP7_SQL}
