"""A training corpus in five stages: toxicity, near duplicates, repeated passages, benchmark decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of ``documents``. Rows of null ids or texts and repeated rows go through by the rules of
the operators; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.jaccard import similar_documents
from quaverlake.llm.ordinal import scored, toxicity_model
from quaverlake.llm.packing import pack_texts
from quaverlake.llm.queries import table, tokenizer_path
from quaverlake.llm.repeats import strip_repeats
from quaverlake.llm.tables import settled, sized, spare, written
from quaverlake.llm.templates import without_leaks


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, does not reject."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where("NOT toxic").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the smallest id (without ids, the smallest text hash). Empty documents stay."""
    settled(spark)
    key = spare(docs, "__key")
    keyed = docs.withColumn(key, F.format_string("%020d-%016x", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), F.xxhash64("text")))
    groups = similar_documents(keyed, id_col=key)
    first = written(groups.where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("rows")))
    single = keyed.join(sized(written(first.where("rows = 1").select(key))), key, "left_semi")
    repeated = keyed.join(sized(written(first.where("rows > 1").select(key))), key, "left_semi").dropDuplicates([key])
    return single.union(repeated).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start in two places; the length column follows the text."""
    settled(spark)
    return strip_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in its own words or re-parameterised."""
    settled(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    settled(spark)
    return pack_texts(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the fitted model, the components, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
