"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from quillmark.llm import bpe, embedding_dedup, exact_dedup, html_extract, minhash_dedup, packing, suffix_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_packing": packing.query,
    "op3_minhash_dedup": minhash_dedup.query,
    "op4_url_filter": url_filter.query,
    "op5_html_extract": html_extract.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op8_token_counts": token_counts.query,
    "op9_toxicity": toxicity.query,
    "op10_exact_dedup": exact_dedup.query,
}
ORACLES = {
    "op4_url_filter": url_filter.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
