"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from tallgrass.llm.chaining import op1_fuzzy_passages
from tallgrass.llm.decontaminate import OP3_SQL, op3_decontamination
from tallgrass.llm.langid import op7_language_id
from tallgrass.llm.lm import op10_lm_scores
from tallgrass.llm.minhash import OP8_SQL, op8_near_duplicates
from tallgrass.llm.packing import op2_packing
from tallgrass.llm.rollups import OP6_SQL, op6_token_rollups
from tallgrass.llm.secrets import op9_secret_scan
from tallgrass.llm.substrings import op4_substring_dedup
from tallgrass.llm.topk import OP5_SQL, op5_top_k

QUERIES = {
    f.__name__: f
    for f in (op1_fuzzy_passages, op2_packing, op3_decontamination, op4_substring_dedup, op5_top_k, op6_token_rollups, op7_language_id, op8_near_duplicates, op9_secret_scan, op10_lm_scores)
}
SQL = {"op3_decontamination": OP3_SQL, "op5_top_k": OP5_SQL, "op6_token_rollups": OP6_SQL, "op8_near_duplicates": OP8_SQL}
