"""Queries of this subpackage and their DuckDB counterparts, where SQL can express them."""

from __future__ import annotations

from veldspar.llm import chat_format, conversation_trie, decontaminate, exact_dedup, importance_resample, license_scan, ngram_join, pii, secret_scan, source_mix, topk_search, toxicity, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pii": pii.op4_pii,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_source_mix": source_mix.op8_source_mix,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_topk_search": topk_search.op11_topk_search,
    "op12_importance_resample": importance_resample.op12_importance_resample,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
ORACLES = {
    "op1_decontaminate": decontaminate.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op6_ngram_jaccard_join": ngram_join.SQL,
    "op7_url_filter": url_filter.SQL,
    "op9_chat_format": chat_format.SQL,
    "op10_license_scan": license_scan.SQL,
    "op11_topk_search": topk_search.SQL,
    "op12_importance_resample": importance_resample.SQL,
    "op13_conversation_trie": conversation_trie.SQL,
}
