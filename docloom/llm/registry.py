"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import chats, divergence, embedding_dedup, html_extract, language_id, license_scan, manifest, media, mixing, near_dedup, packing, secret_scan, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": media.op1_media_columns,
        "op2_language_profiles": language_id.op2_language_profiles,
        "op3_secret_ownership": secret_scan.op3_secret_ownership,
        "op4_toxic_sentences": toxicity.op4_toxic_sentences,
        "op5_subspace_pigeonhole": embedding_dedup.op5_subspace_pigeonhole,
        "op6_dart_minhash": near_dedup.op6_dart_minhash,
        "op7_page_templates": html_extract.op7_page_templates,
        "op8_source_mix": mixing.op8_source_mix,
        "op9_pattern_packing": packing.op9_pattern_packing,
        "op10_chat_snapshots": chats.op10_chat_snapshots,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_license_signatures": license_scan.op12_license_signatures,
        "op13_merkle_proofs": manifest.op13_merkle_proofs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_ownership": secret_scan.OP3_SQL,
        "op5_subspace_pigeonhole": embedding_dedup.OP5_SQL,
        "op8_source_mix": mixing.OP8_SQL,
        "op10_chat_snapshots": chats.OP10_SQL,
        "op11_source_divergence": divergence.OP11_SQL,
        "op12_license_signatures": license_scan.OP12_SQL,
        "op13_merkle_proofs": manifest.OP13_SQL,
    }
