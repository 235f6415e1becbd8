"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from ambler.llm import bpe, chat, langid, near_dedup, packing, quality, sharding, sql, substring_dedup, topk, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_rendezvous_sharding,
        near_dedup.op2_minhash_near_dedup,
        url_filter.op3_redirect_url_filter,
        bpe.op4_transducer_bpe,
        langid.op5_bitmask_langid,
        chat.op6_chat_format,
        packing.op7_concat_packing,
        quality.op8_compression_quality,
        quality.quality_base_rules,
        substring_dedup.op9_gear_substring_dedup,
        topk.op10_cover_tree_topk,
    )
}

ORACLES = {
    "op1_rendezvous_sharding": sql.op1(),
    "op2_minhash_near_dedup": sql.op2(),
    "op3_redirect_url_filter": sql.op3(),
    "op6_chat_format": sql.op6(),
    "op10_cover_tree_topk": sql.op10(),
    "quality_base_rules": sql.quality_base(),
}
