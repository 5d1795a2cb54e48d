"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from . import alignment, conversations, decontaminate, embeddings, fingerprints, language, licenses, lines, minhash, mixing, substrings, suffixes, toxicity

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_language_id": language.op5_language_id,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}

SQL = {
    "op1_substring_dedup": substrings.SQL,
    "op4_license_scan": licenses.SQL,
    "op6_suffix_dedup": suffixes.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op8_minhash_near_dedup": minhash.SQL,
    "op9_mix_sources": mixing.SQL,
    "op10_embedding_near_dedup": embeddings.SQL,
    "op12_conversation_repair": conversations.SQL,
}
