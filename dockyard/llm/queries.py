"""Queries of the corpus operators and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from dockyard.llm import collocations, embedding_dedup, html_text, lexical, licences, minhash, mixing, packing, pii, secret_scan, topk, toxicity, url_filter

QUERIES = {
    "op4_source_mixing": mixing.op4_source_mixing,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op3_embedding_near_dedup": embedding_dedup.op3_embedding_near_dedup,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op1_license_scans": licences.op1_license_scans,
    "op8_pii_pseudonyms": pii.op8_pii_pseudonyms,
    "op9_url_filters": url_filter.op9_url_filters,
    "op10_html_extraction": html_text.op10_html_extraction,
    "op11_secret_scans": secret_scan.op11_secret_scans,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}
SQL = {
    "op6_exact_top_k": topk.OP6_SQL,
    "op3_embedding_near_dedup": embedding_dedup.OP3_SQL,
    "op5_minhash_near_dedup": minhash.OP5_SQL,
    "op1_license_scans": licences.OP1_SQL,
    "op9_url_filters": url_filter.OP9_SQL,
    "op11_secret_scans": secret_scan.OP11_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
    "op13_phrase_collocations": collocations.OP13_SQL,
}
