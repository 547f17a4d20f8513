"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from lodestone.llm import bpe, chat, fingerprint, jaccard, licenses, minhash, packing, quality, shards, suffix, toxicity, trie, whitening

QUERIES = {
    "op1_document_fingerprints": fingerprint.op1_document_fingerprints,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_packing": packing.op3_packing,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_license_scans": licenses.op6_license_scans,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_binary_output": shards.op8_binary_output,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_superminhash_dedup": minhash.op11_superminhash_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_conversation_trie": trie.op13_conversation_trie,
}

ORACLE = {
    "op9_ngram_jaccard": jaccard.OP9_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op11_superminhash_dedup": minhash.OP11_SQL,
    "op13_conversation_trie": trie.OP13_SQL,
}
