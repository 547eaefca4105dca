"""Labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import bounded_sample, free_name


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, learnable: Column | None, bound: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, text, y`` of at most ``bound`` labelled rows.

    ``learnable`` says over the id column of ``labels`` which rows may be
    learnt from.  Ids and labels of the sample are small (``bound`` rows), so
    they are broadcast and the texts are not shuffled.  An id with several
    labels counts with the largest; null ids and labels are left out.
    """
    sample = bounded_sample(
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (F.lit(True) if learnable is None else learnable))
        .groupBy(id_col).agg(F.max(label).cast("int").alias("y")),
        id_col, bound,
    )
    chosen = sample.select(F.col(id_col).alias("id"), "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id")


def sigmoid_score(docs: DataFrame, text_col: str, score, name: str | None = None) -> DataFrame:
    """``docs`` with a score in 0 to 1 from ``score(column of texts) -> array``.

    The score is the last column, ``score`` or ``name``; if ``docs`` has a
    column of that name, which stays, a suffix is added.  All rows stay.
    """
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    name = free_name(docs, name or "score")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            values = pa.array(score(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
