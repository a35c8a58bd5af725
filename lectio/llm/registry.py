"""The queries of this subpackage by name, with the SQL that gives the same rows."""

from __future__ import annotations

from lectio.llm import chat, embeddings, lexical, line_dedup, mixing, packing, pieces, quality_model, quality_rules, simhash, suffix_dedup, trie, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op3_quality_model": quality_model.op3_quality_model,
    "op5_embeddings": embeddings.op5_embeddings,
    "op4_simhash": simhash.op4_simhash,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_chat_template": chat.op8_chat_template,
    "op2_packing": packing.op2_packing,
    "op6_mixing": mixing.op6_mixing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_lexical": lexical.op12_lexical,
    "op13_pieces": pieces.op13_pieces,
    "quality_rules_ablation": quality_rules.quality_rules_ablation,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op5_embeddings": embeddings.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_chat_template": chat.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_lexical": lexical.ORACLE,
    "quality_rules_ablation": quality_rules.ABLATION_ORACLE,
}
