"""The subpackage's registered queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from corpusflow.llm import alignment, decontaminate, language_id, license_scan, mixing, ngram_join, passages, prefix_trie, quality, rules, suffix_dedup, toxicity, word_bpe

QUERIES = {
    "op1_near_passages": passages.op1_near_passages,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_language_id": language_id.op10_language_id,
    "op11_alignment": alignment.op11_alignment,
    "op12_word_bpe": word_bpe.op12_word_bpe,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op2_ngram_join": ngram_join.SQL,
    "op6_license_scan": license_scan.SQL,
    "op8_source_mix": mixing.SQL,
    "op9_quality_rules": rules.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
