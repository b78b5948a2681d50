"""The queries of this subpackage: whole tables in, full results out."""

from __future__ import annotations

from . import (
    exact_dedup,
    jaccard_join,
    line_dedup,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    source_mix,
    suffix_dedup,
    url_filter,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op2_source_mix": source_mix.op2_source_mix,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "rule_ablation": quality_rules.rule_ablation,
}
ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op6_jaccard_join": jaccard_join.SQL,
    "op8_secret_scan": secret_scan.SQL,
    "rule_ablation": quality_rules.ABLATION_SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
