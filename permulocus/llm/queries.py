"""The registered queries of this subpackage and their oracle SQL."""

from . import chat, decontaminate, exact_dedup, language, line_dedup, packing, prefix_trie, quality, secrets, simhash, spelling, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_warc": warc.op5_warc,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_language_id": language.op8_language_id,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_secret_scans": secrets.OP6_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
