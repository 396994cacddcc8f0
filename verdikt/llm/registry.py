"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from verdikt.llm import dsir, html_template, lcp, license_scan, packing, passages, quality_rules, quotes, repair, sentence_fst, simhash, spelling, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_warc": warc.op2,
    "op3_license_scan": license_scan.op3,
    "op4_quote_threads": quotes.op4,
    "op5_best_fit_packing": packing.op5,
    "op6_sentence_fst": sentence_fst.op6,
    "op7_fingerprints": lcp.op7,
    "op8_main_text": html_template.op8,
    "op9_simhash_dedup": simhash.op9,
    "op10_quality_classifier": dsir.op10,
    "op11_conversation_repair": repair.op11,
    "op12_spelling_groups": spelling.op12,
    "op13_substring_dedup": passages.op13,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
}
