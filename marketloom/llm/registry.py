"""The queries of the corpus operators, and their SQL where SQL can express them."""

from marketloom.llm import chat, counts, decontaminate, jaccard, mixing, packing, pii, quality, runs, secrets, suffixes, tokens, vectors

QUERIES = {
    "op1_secret_scans": secrets.query,
    "op2_ngram_jaccard_join": jaccard.query,
    "op3_mixing": mixing.query,
    "op4_token_counts": counts.query,
    "op5_suffix_array_dedup": suffixes.query,
    "op6_decontamination": decontaminate.query,
    "op7_pii": pii.query,
    "op8_quality_rules": quality.query,
    "op9_chat_formatting": chat.query,
    "op10_token_output": tokens.query,
    "op11_best_fit_packing": packing.query,
    "op12_vector_codes": vectors.query,
    "op13_periodic_runs": runs.query,
}
ORACLES = {
    "op2_ngram_jaccard_join": jaccard.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op12_vector_codes": vectors.ORACLE,
}
