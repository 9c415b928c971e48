"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from tesserae.llm import fingerprint, html, jaccard, lm, mixing, packing, phrases, quality, sharding, suffixes, tokenfiles, trie, urls

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_suffix_array_dedup": suffixes.op2_suffix_array_dedup,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_url_filters": urls.op6_url_filters,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_token_files": tokenfiles.op12_token_files,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
}
SQL = {"op3_ngram_jaccard_join": jaccard.OP3_SQL, "op4_quality_rules": quality.OP4_SQL, "op9_mixing": mixing.OP9_SQL, "op11_prefix_trie": trie.OP11_SQL, "op13_phrase_collocations": phrases.OP13_SQL}
