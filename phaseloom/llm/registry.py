"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, context_tree, conversation_repair, decontaminate, exact_dedup, packing, periodic, pipeline, quality_model, quality_rules, simhash, suffix_dedup, token_counts, word_bpe
from .common import ship_code

_QUERIES = {
    "op1_quality_model": quality_model.op1_quality_model,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_chat": chat.op4_chat,
    "op5_simhash": simhash.op5_simhash,
    "op6_bpe": word_bpe.op6_bpe,
    "op7_packing": packing.op7_packing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_context_tree": context_tree.op10_context_tree,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_periodic_runs": periodic.op13_periodic_runs,
    "pipeline": pipeline.run,
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": chat.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
