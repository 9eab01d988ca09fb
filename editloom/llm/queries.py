"""The queries of this package and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from editloom.llm import bloom, bpe, html, licences, mixing, polytope, quality, rabitq, sharding, simhash


def queries() -> dict:
    return {
        "op1_importance_resampling": quality.op1,
        "op2_mix_sources": mixing.op2,
        "op3_html_layout": html.op3,
        "op4_rabitq_neighbours": rabitq.op4,
        "op5_simhash_near_dedup": simhash.op5,
        "op6_licence_scan": licences.op6,
        "op7_bpe_trie": bpe.op7,
        "op8_hypergeometric_shards": sharding.op8,
        "op9_bloom_cascade": bloom.op9,
        "op10_polytope_near_dedup": polytope.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.op2_sql(),
        "op6_licence_scan": licences.op6_sql(),
        "op9_bloom_cascade": bloom.op9_sql(),
    }
