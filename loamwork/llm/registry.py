"""Name to query and name to SQL of the training-data operators."""

from __future__ import annotations

from loamwork.llm import (
    decontamination,
    importance,
    jaccard_join,
    language_id,
    license_scan,
    merkle,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    sharding,
    simhash,
    substring_dedup,
)

MODULES = (sharding, sentencepiece_codec, license_scan, quality_rules, quality_classifier, language_id, secret_scan, jaccard_join, decontamination, substring_dedup, simhash, merkle, importance)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
