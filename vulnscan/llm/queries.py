"""Registry of the training-data queries: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from . import (
    base_columns,
    decontamination,
    hard_negatives,
    jaccard_join,
    license_scan,
    packing,
    periodic_runs,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    token_count,
    url_filter,
)

QUERIES = {
    "op1_token_count": token_count.query,
    "op2_packing": packing.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_license_scan": license_scan.query,
    "op5_quality_rules": quality_rules.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_pii": pii.query,
    "op8_decontamination": decontamination.query,
    "op9_sharding": sharding.query,
    "op10_url_filter": url_filter.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_simhash": simhash.query,
    **base_columns.QUERIES,
}
ORACLE = {
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    **base_columns.ORACLE,
}
