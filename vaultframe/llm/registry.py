"""Queries and oracles of the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from . import line_dedup, media, mixing, near_dedup, packing, pii, quality_model, quality_rules, quotes, substring_dedup

QUERIES = {
    "op1_semi_markov_pii": pii.query,
    "op2_mixture_packing": packing.query,
    "op3_paragraph_banding": substring_dedup.query,
    "op4_boosted_trees": quality_model.query,
    "op5_pfair_mixing": mixing.query,
    "op6_quotation_linking": quotes.query,
    "op7_telephony_audio": media.query,
    "op8_minhash_near_dedup": near_dedup.query,
    "op9_line_dedup": line_dedup.query,
    "op10_weak_supervision": quality_rules.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op6_quotation_linking": quotes.ORACLE,
    "op8_minhash_near_dedup": near_dedup.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
