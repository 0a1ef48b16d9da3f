"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, exact_dedup, extraction, mixing, pii, quality, secrets, simhash, sketch, token_codes, topk, vector_codes

QUERIES = {
    "op1_extract_text": extraction.op1_extract_text,
    "op2_quality": quality.op2_quality,
    "op3_sketch": sketch.op3_sketch,
    "op4_token_codes": token_codes.op4_token_codes,
    "op5_private": pii.op5_private,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_simhash": simhash.op7_simhash,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_secrets": secrets.op9_secrets,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_exact_topk": topk.op11_exact_topk,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_alignment": alignment.op13_alignment,
}

SQL = {
    "op6_mix_sources": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_exact_topk": topk.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
