"""Corpus pipeline: from documents to a mixed training set.

Each stage is ``(name, function)``; a function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame.  Stages work on all that their
predecessor kept.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starweave.llm import mixing, secrets, simhash, suffixes, toxicity
from starweave.llm.common import crc32_of, free_name, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic at the threshold go.  Labels of the held-out third are not learnt from."""
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"), crc32_of("doc_id") % 3 != 1)
    score = free_name(docs, "score")
    return toxicity.score_toxicity(docs, model, name=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item stand go."""
    return suffixes.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; ``n_chars`` is counted anew where one did.  All documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with ``size, source_size, target, taken``."""
    return mixing.with_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL expresses neither the classifier nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; what one keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
