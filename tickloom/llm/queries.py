"""The queries of this subpackage and their SQL."""

from . import conversation_trie, decontamination, fingerprints, html_text, minhash, quality, rule_ledger, sampled_pieces, secrets, spelling, token_counts, url_filters, warc

QUERIES = {
    "op1_sampled_pieces": sampled_pieces.op1_sampled_pieces,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_warc": warc.op3_warc,
    "op4_html_text": html_text.op4_html_text,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_minhash": minhash.op6_minhash,
    "op7_secrets": secrets.op7_secrets,
    "op8_quality": quality.op8_quality,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_quality_rules": rule_ledger.op13_quality_rules,
}

#: Where SQL cannot express an operator, tests/llm holds it against brute force.
SQL = {
    "op2_decontamination": decontamination.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op9_url_filters": url_filters.OP9_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_conversation_trie": conversation_trie.OP12_SQL,
    "op13_quality_rules": rule_ledger.OP13_SQL,
}
