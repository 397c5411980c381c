"""Queries of the numbered operators and of the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import infill, mixing, ngram_join, packing, pii, quality, rules, secrets, simhash, telephony, toxicity, warc, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_classifier": quality.query,
    "op2_mix_sources": mixing.query,
    "op3_quality_rules": rules.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_telephony_audio": telephony.query,
    "op6_personal_data": pii.query,
    "op7_best_fit_packing": packing.query,
    "op8_warc_revisits": warc.query,
    "op9_toxicity": toxicity.query,
    "op10_secret_scan": secrets.query,
    "op11_embedding_whitening": whitening.query,
    "op12_ngram_jaccard_join": ngram_join.query,
    "op13_fill_in_middle": infill.query,
}

ORACLE_SQL = {
    "op2_mix_sources": mixing.SQL,
    "op3_quality_rules": rules.SQL,
    "op8_warc_revisits": warc.SQL,
    "op13_fill_in_middle": infill.SQL,
}
