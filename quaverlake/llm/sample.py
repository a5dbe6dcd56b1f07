"""A bounded sample of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.tables import sized, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int, *, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """(text, label) of at most ``rows`` labelled ids, those of least hash; the bound is on ids, and every row of a chosen id is in.

    An id with several labels has their largest; null ids and labels are left out; null texts count as empty.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), label.cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    if where is not None:
        known = known.where(where)
    chosen = written(known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return written(texts.join(sized(chosen), "id").select("text", "label").repartition(16))
