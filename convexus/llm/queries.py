"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, kneser_ney, near_documents, near_embeddings, packing, sharding, suffix_dedup, topk, toxicity, url_filter

QUERIES = {
    "op1_near_embeddings": near_embeddings.op1_near_embeddings,
    "op2_packing": packing.op2_packing,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_topk": topk.op5_topk,
    "op6_sharding": sharding.op6_sharding,
    "op7_quality": kneser_ney.op7_quality,
    "op8_near_documents": near_documents.op8_near_documents,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_bpe": bpe.op10_bpe,
}

SQL = {
    "op1_near_embeddings": near_embeddings.OP1_SQL,
    "op5_topk": topk.OP5_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
}
