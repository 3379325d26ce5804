"""Queries of the training-data operators, by name, with their SQL where SQL can say them."""

from __future__ import annotations

from winnow_spark.llm import fingerprints, jaccard_join, licenses, mixing, quality, sentencepieces, sharding, token_counts, toxicity, url_filters

QUERIES = {
    f.__name__: f
    for f in (
        url_filters.op1_url_filters,
        token_counts.op2_token_counts,
        quality.op3_quality_rules,
        jaccard_join.op4_ngram_jaccard,
        fingerprints.op5_fingerprints,
        sentencepieces.op6_sentencepiece,
        sharding.op7_sharding,
        toxicity.op8_toxicity,
        licenses.op9_license_scans,
        mixing.op10_mixing,
    )
}
ORACLES = {"op1_url_filters": url_filters.ORACLE, "op4_ngram_jaccard": jaccard_join.ORACLE, "op7_sharding": sharding.ORACLE, "op10_mixing": mixing.ORACLE}
