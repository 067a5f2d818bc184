"""Registered queries of the training-data operators, with the DuckDB SQL of those that SQL expresses."""

from __future__ import annotations

from renewlens.llm import decontaminate, hnsw, language_id, lm_scoring, minhash, pii, prefix_trie, resharding, size_join, structure_repair, token_files, toxicity, tree_bpe

QUERIES = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_hnsw": hnsw.query,
    "op3_pii": pii.query,
    "op4_minhash": minhash.query,
    "op5_token_files": token_files.query,
    "op6_language_id": language_id.query,
    "op7_tree_bpe": tree_bpe.query,
    "op8_resharding": resharding.query,
    "op9_decontaminate": decontaminate.query,
    "op10_toxicity": toxicity.query,
    "op11_size_join": size_join.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_structure_repair": structure_repair.query,
}

ORACLES = {
    "op4_minhash": minhash.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_size_join": size_join.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
