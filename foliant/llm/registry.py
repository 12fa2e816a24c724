"""The queries of the corpus operators and of the pipeline, and their SQL, for __spark_entry__."""

from __future__ import annotations

import corpus_pipeline
from foliant.llm import decontam, html_text, line_dedup, minhash, negatives, packing, pii, quality, sharding, topk, toxicity, turns, warc

OPERATORS = {
    "op1_html_text": html_text,
    "op2_decontamination": decontam,
    "op3_line_dedup": line_dedup,
    "op4_pii": pii,
    "op5_packing": packing,
    "op6_warc": warc,
    "op7_minhash": minhash,
    "op8_quality": quality,
    "op9_toxicity": toxicity,
    "op10_top_k": topk,
    "op11_sharding": sharding,
    "op12_hard_negatives": negatives,
    "op13_turn_repair": turns,
}


def queries() -> dict:
    return {name: m.query for name, m in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in OPERATORS.items() if hasattr(m, "ORACLE")}
