"""The queries of this subpackage, and their SQL where SQL can express them."""

from wordloom.llm import bpe_codec, decontaminate, exact_dedup, flac, hmm, line_dedup, merkle, mixing, near_dedup, prefix_trie, quality, substring_dedup, tokens

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_flac": flac.op2_flac,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_hmm": hmm.op7_hmm,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_bpe_codec": bpe_codec.op9_bpe_codec,
    "op10_quality": quality.op10_quality,
    "op11_merkle": merkle.op11_merkle,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_decontaminate": decontaminate.ORACLE,
}
