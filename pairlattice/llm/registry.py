"""Queries of the corpus operators by name, and the SQL of those that SQL can express."""

from pairlattice.llm import alignment, ann, bpe, fill_middle, hmm, html_text, jaccard_join, mixing, pii, quality, quotation, sharding, substring_dedup

QUERIES = {
    "op1_ann": ann.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_hmm_scores": hmm.query,
    "op4_pii": pii.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_bpe": bpe.query,
    "op7_quality_rules": quality.query,
    "op8_mix_sources": mixing.query,
    "op9_quotation_linking": quotation.query,
    "op10_html_text": html_text.query,
    "op11_fill_middle": fill_middle.query,
    "op12_sharding": sharding.query,
    "op13_token_alignment": alignment.query,
}
ORACLES = {
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op9_quotation_linking": quotation.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_sharding": sharding.ORACLE,
}
