"""Queries of this package over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import (
    byte_bpe,
    conversation_repair,
    jaccard_join,
    language_id,
    nearest,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    spelling_variants,
    substring_dedup,
    token_counts,
    toxicity,
)
from tallybook.llm.batches import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on_documents: dict[str, Callable[[DataFrame], DataFrame]] = {
        "op1_byte_bpe": byte_bpe.encode_digests,
        "op2_quality_rules": quality_rules.judge,
        "op3_substring_dedup": substring_dedup.passages,
        "op4_token_counts": token_counts.count_tokens,
        "op6_language_id": language_id.identify,
        "op8_sharding": sharding.shard,
        "op9_packing": packing.pack,
        "op10_jaccard_join": jaccard_join.join,
        "op11_spelling_variants": lambda docs: spelling_variants.variants(docs, spelling_variants.DAMAGE),
    }

    def over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))

    def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

    def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
        return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

    def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
        return conversation_repair.repair_digests(read(spark, sf_dir, "conversations"))

    registered = {name: over_documents(operator) for name, operator in on_documents.items()}
    registered["op5_quality_classifier"] = quality
    registered["op7_nearest_neighbours"] = lambda spark, sf_dir: nearest.search(read(spark, sf_dir, "embeddings"))
    registered["op12_conversation_repair"] = repaired
    registered["op13_toxicity"] = toxic
    return registered


def oracle_sql() -> dict[str, str]:
    slots = ", ".join(
        f"({slot}, '{sharding.SHARDS[k]}')" for slot, k in enumerate(sharding.lookup_table())
    )
    return {
        "op2_quality_rules": quality_rules.judge_sql(),
        "op8_sharding": f"""
            SELECT doc_id, slot, shard
            FROM (SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT % {sharding.SLOTS} AS slot
                  FROM documents)
            JOIN (VALUES {slots}) AS t(slot, shard) USING (slot)""",
        "op11_spelling_variants": spelling_variants.variants_sql(),
        "op12_conversation_repair": conversation_repair.repair_digests_sql(),
    }
