"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tideline.llm import licenses, linededup, merkle, mixing, packing, pieces, pii, quality, sharding, simhash, substring, topk, variants

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_poisson_mixing": mixing.op4_poisson_mixing,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_rendezvous_sharding": sharding.op8_rendezvous_sharding,
    "op9_pii_pseudonyms": pii.op9_pii_pseudonyms,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_spelling_variants": variants.op13_spelling_variants,
}
ORACLE_SQL = {
    "op1_exact_topk": topk.ORACLE,
    "op4_poisson_mixing": mixing.ORACLE,
    "op5_line_dedup": linededup.ORACLE,
    "op8_rendezvous_sharding": sharding.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
