"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, clustering, language, media, mixing, neardups, pages, quality, resampling, scoring, secrets, topk, toxicity

QUERIES = {
    "op1_minhash_dedup": neardups.op1_minhash_dedup,
    "op2_suffix_tree": scoring.op2_suffix_tree,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_html_text": pages.op7_html_text,
    "op8_media_webp": media.op8_media_webp,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language_id": language.op10_language_id,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_topk_search": topk.op12_topk_search,
    "op13_elkan_clusters": clustering.op13_elkan_clusters,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_minhash_dedup": neardups.SQL,
    "op3_quality_rules": quality.SQL,
    "op4_mixing": mixing.SQL,
    "op11_importance_resampling": resampling.SQL,
    "op12_topk_search": topk.SQL,
    "op13_elkan_clusters": clustering.SQL,
}
