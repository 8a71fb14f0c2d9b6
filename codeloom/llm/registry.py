"""Corpus queries and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff, decontam, kmeans, ledger, mixing, neardup, personal, quality, repeats, sharding, sql, tokens, trie, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_sharding": sharding.op2_sharding,
        "op3_mixing": mixing.op3_mixing,
        "op4_repeats": repeats.op4_repeats,
        "op5_lm_scores": backoff.op5_lm_scores,
        "op6_secrets": ledger.op6_secrets,
        "op7_near_vectors": vectors.op7_near_vectors,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_near_duplicates": neardup.op9_near_duplicates,
        "op10_token_output": tokens.op10_token_output,
        "op11_conversation_trie": trie.op11_conversation_trie,
        "op12_personal_data": personal.op12_personal_data,
        "op13_clusters": kmeans.op13_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_lm_scores": sql.OP5, "op6_secrets": sql.OP6, "op7_near_vectors": sql.OP7, "op8_decontamination": decontam.OP8_SQL, "op9_near_duplicates": sql.OP9, "op11_conversation_trie": sql.OP11, "op13_clusters": kmeans.OP13_SQL}
