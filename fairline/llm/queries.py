"""The registered queries of the document operators and the SQL that checks them."""

from __future__ import annotations

from fairline.llm import bpe, fingerprints, licenses, line_dedup, packing, prefix_trie, quality_classifier, quality_rules, repair, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_packing": packing.op2_packing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_bpe": bpe.op4_bpe,
    "op5_simhash": simhash.op5_simhash,
    "op6_sharding": sharding.op6_sharding,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_licenses": licenses.op8_licenses,
    "op9_warc": warc.op9_warc,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_repair": repair.op12_repair,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE_SQL = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op8_licenses": licenses.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_repair": repair.OP12_SQL,
}
