"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from oriel.llm import clustering, collocations, line_dedup, media, mixing, pieces, pii, quality_classifier, quality_rules, sharding, simhash, token_counts, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_simhash_components": simhash.op3_simhash_components,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_shard_documents": sharding.op5_shard_documents,
    "op6_sentence_pieces": pieces.op6_sentence_pieces,
    "op7_pii_surrogates": pii.op7_pii_surrogates,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_media_sequences": media.op9_media_sequences,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_clusters": clustering.op11_clusters,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op11_clusters": clustering.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
