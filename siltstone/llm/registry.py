"""The corpus queries and their SQL."""

from . import decontaminate, exact, packing, pii, sentences, sharding, simhash, suffixes, token_files, toxicity

QUERIES = {
    "op1_hash_tree_shards": sharding.op1_hash_tree_shards,
    "op2_anchor_expansion_pii": pii.op2_anchor_expansion_pii,
    "op3_token_files": token_files.op3_token_files,
    "op4_sentence_spans": sentences.op4_sentence_spans,
    "op5_simhash_windows": decontaminate.op5_simhash_windows,
    "op6_suffix_array_dedup": suffixes.op6_suffix_array_dedup,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_compression_toxicity": toxicity.op8_compression_toxicity,
    "op9_pigeonring_simhash": simhash.op9_pigeonring_simhash,
    "op10_power_of_two_packing": packing.op10_power_of_two_packing,
}

ORACLES = {
    "op1_hash_tree_shards": sharding.oracle(),
    "op4_sentence_spans": sentences.ORACLE,
    "op7_exact_dedup": exact.ORACLE,
}
