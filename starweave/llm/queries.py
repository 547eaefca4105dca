"""Registered queries: each applies one operator to its whole table.

The queries are thin: they derive the fixed digest columns from what the
operators return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from starweave.llm import audit, language, licences, mixing, neighbours, phrases, prefixes, quality, secrets, simhash, sketches, suffixes, toxicity
from starweave.llm.common import crc32_of, table
from starweave.llm.oracles import ORACLES


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id"
    )


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = phrases.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", phrases.sha256_hex(F.col("kept")).alias("kept_sha256"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixes.verbatim_matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "matches")
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id", "n_words", suffixes.covered(F.col("matches")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"),
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the top directory, hundreds of ids are folders in it."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    found = licences.scan_licences(docs.select(path.alias("path"), "text"))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), *found.columns)


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints_with_edit(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _scored(scored: DataFrame, modulus: int, held_out: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", (crc32_of("doc_id") % modulus == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"), crc32_of("doc_id") % 4 != 2)
    return _scored(quality.score_quality(docs, model, name="score"), 4, 2, quality.THRESHOLD)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.language_model(docs, crc32_of("doc_id") % 5 != 0)
    return language.predict_language(docs.select("doc_id", "text"), net).select(
        "doc_id", (crc32_of("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score"
    )


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"), crc32_of("doc_id") % 3 != 1)
    return _scored(toxicity.score_toxicity(docs, model, name="score"), 3, 1, toxicity.THRESHOLD)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    return found.select(
        "doc_id", *[secrets.count_of(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.joined(spans, ("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(spans).alias("spans"),
    )


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from the first turns of another one: h of them, then one's own behind the first h."""
    own = prefixes.turn_sequences(table(spark, sf_dir, "conversations"))
    heads = own.where(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    told = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": (crc32_of("conv_id") % 9).cast("int")})
    rebuilt = F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>")), F.slice("turns", F.col("h") + 1, F.size("turns"))
    )
    return prefixes.prefix_trie(told.join(heads, "base", "left").select("conv_id", rebuilt.alias("turns")))


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": near_dedup,
    "op2_substring_dedup": substring_dedup,
    "op3_benchmark_decontamination": decontamination,
    "op4_license_scan": license_scan,
    "op5_source_mixing": source_mixing,
    "op6_quality_classifier": quality_classifier,
    "op7_language_id": language_id,
    "op8_document_fingerprints": document_fingerprints,
    "op9_toxicity": toxicity_scores,
    "op10_secret_scan": secret_scan,
    "op11_conversation_trie": conversation_trie,
    "op12_filter_audit": filter_audit,
    "op13_nearest_neighbours": nearest_vectors,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in _QUERIES}
