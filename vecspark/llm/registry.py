"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import flatbin, html, jaccard, media, mixing, packing, quality, sharding, toxicity, urls

QUERIES = {
    "op1_page_text": html.op1_page_text,
    "op2_similar_sets": jaccard.op2_similar_sets,
    "op3_hilbert_shards": sharding.op3_hilbert_shards,
    "op4_host_rules": quality.op4_host_rules,
    "op5_toxic_segments": toxicity.op5_toxic_segments,
    "op6_transport_streams": media.op6_transport_streams,
    "op7_flat_token_files": flatbin.op7_flat_token_files,
    "op8_concat_and_cut": packing.op8_concat_and_cut,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_url_rules": urls.op10_url_rules,
}

ORACLE = {
    "op4_host_rules": quality.OP4_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_url_rules": urls.OP10_SQL,
}
