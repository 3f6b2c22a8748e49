"""The queries of this subpackage, and SQL for those that SQL can express."""

from archlens.llm import ann, bpe, caps, html, jaccard, merkle, nnls, packing, resampling, secrets, sharding, suffixes, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_nearest_vectors": ann.op2_nearest_vectors,
    "op3_bpe_round_trip": bpe.op3_bpe_round_trip,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_secrets": secrets.op5_secrets,
    "op6_repeated_strings": suffixes.op6_repeated_strings,
    "op7_shard_documents": sharding.op7_shard_documents,
    "op8_embedding_near_duplicates": caps.op8_embedding_near_duplicates,
    "op9_main_text": html.op9_main_text,
    "op10_pack": packing.op10_pack,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_window_packing": nnls.op13_window_packing,
}

ORACLE_SQL = {"op5_secrets": secrets.oracle(), "op7_shard_documents": sharding.oracle(), "op8_embedding_near_duplicates": caps.oracle(), "op11_merkle_manifest": merkle.oracle(), "op12_importance_resampling": resampling.oracle()}
