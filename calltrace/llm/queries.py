"""Registered queries of the training-data operators."""

from __future__ import annotations

from calltrace.llm import collocations, decontamination, exact_dedup, line_dedup, mixing, ngram_join, pii, secret_scan, substring_dedup, token_counts, token_output, toxicity, whitening

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_token_output": token_output.op7_token_output,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pii": pii.op9_pii,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op13_phrase_collocations": collocations.OP13_SQL,
}
