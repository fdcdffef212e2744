"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, caps, codes, fill_in_middle, line_dedup, mixing, permutation_index, quality_classifier, quality_rules, secrets, sharding, simhash, toxicity

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_toxicity": toxicity.query,
    "op3_line_dedup": line_dedup.query,
    "op4_sharding": sharding.query,
    "op5_secret_scan": secrets.query,
    "op6_permutation_index": permutation_index.query,
    "op7_quality_rules": quality_rules.query,
    "op8_mixing": mixing.query,
    "op9_bpe": bpe.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_vector_codes": codes.query,
    "op12_embedding_near_dedup": caps.query,
    "op13_fill_in_middle": fill_in_middle.query,
}
ORACLES = {
    "op3_line_dedup": line_dedup.SQL,
    "op11_vector_codes": codes.SQL,
    "op12_embedding_near_dedup": caps.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
