"""The subpackage's entries for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    ann,
    centroids,
    hard_negatives,
    licenses,
    lm_scoring,
    mixing,
    near_dedup,
    pieces,
    pii,
    quality_classifier,
    quality_rules,
    secrets,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_minhash_dedup": near_dedup.op3_minhash_dedup,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_pii": pii.op5_pii,
    "op6_ann": ann.op6_ann,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_centroids": centroids.op11_centroids,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_secrets": secrets.op13_secrets,
    # What SQL can say of the operators above: their base columns, from the same code.
    "license_places": licenses.license_places,
    "pii_base": pii.pii_base,
    "word_count_scores": lm_scoring.word_count_scores,
    "quality_counts": quality_rules.quality_counts,
    "url_rules": url_filter.url_rules,
    "secret_places": secrets.secret_places,
}

ORACLES: dict[str, str] = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "license_places": licenses.PLACES_SQL,
    "pii_base": pii.BASE_SQL,
    "word_count_scores": lm_scoring.COUNT_SCORES_SQL,
    "quality_counts": quality_rules.COUNTS_SQL,
    "url_rules": url_filter.RULES_SQL,
    "secret_places": secrets.PLACES_SQL,
}
