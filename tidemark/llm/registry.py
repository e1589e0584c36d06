"""The operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, licenses, lines, lm, minhash, mixing, negatives, pieces, quality, simhash, substrings, topk, warc

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_minhash_dedup": minhash.op2_minhash_dedup,
    "op3_quality": quality.op3_quality,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_warc": warc.op7_warc,
    "op8_simhash": simhash.op8_simhash,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_line_dedup": lines.op13_line_dedup,
}

ORACLES = {
    "op2_minhash_dedup": minhash.OP2_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_exact_topk": topk.OP9_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_line_dedup": lines.OP13_SQL,
}
