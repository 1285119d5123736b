"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.functions.ship import ship
from tidewell.llm import centroids, chat, decontaminate, jaccard, language, lines, mixing, neardup, negatives, private, substrings, topk, toxicity

_QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_top_k": topk.op2_top_k,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_private": private.op4_private,
    "op5_language": language.op5_language,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_chat": chat.op10_chat,
    "op11_jaccard_join": jaccard.op11_jaccard_join,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_centroids": centroids.op13_centroids,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op2_top_k": topk.SQL, "op6_line_dedup": lines.SQL, "op10_chat": chat.SQL, "op11_jaccard_join": jaccard.SQL, "op12_hard_negatives": negatives.SQL, "op13_centroids": centroids.SQL}
