"""The queries of the numbered operators and the SQL of those that SQL can express."""

from __future__ import annotations

from strandweave.llm import balltree, crosstoken, exactdedup, flac, mixing, neardup, packing, pii, quality, sharding, streamdedup, tokens, variants

QUERIES = {
    "op1_suffix_dedup": exactdedup.op1_suffix_dedup,
    "op2_flac_media": flac.op2_flac_media,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_boosted_pii": pii.op4_boosted_pii,
    "op5_rank_merge_tokens": tokens.op5_rank_merge_tokens,
    "op6_minimax_shards": sharding.op6_minimax_shards,
    "op7_temperature_mixing": mixing.op7_temperature_mixing,
    "op8_ball_tree_topk": balltree.op8_ball_tree_topk,
    "op9_bm25_packing": packing.op9_bm25_packing,
    "op10_minhash_neardup": neardup.op10_minhash_neardup,
    "op11_cross_alignment": crosstoken.op11_cross_alignment,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_stream_dedup": streamdedup.op13_stream_dedup,
}
ORACLE = {"op7_temperature_mixing": mixing.OP7_SQL, "op8_ball_tree_topk": balltree.OP8_SQL, "op12_spelling_variants": variants.OP12_SQL, "op13_stream_dedup": streamdedup.OP13_SQL}
