"""S-01, S-02: Parquet scans with column pruning and pushed-down time bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_numbers(df: DataFrame) -> DataFrame:
    """Decimals as BIGINT where the type holds whole numbers, else as DOUBLE; nested ones too."""
    def plain(t: T.DataType) -> T.DataType:
        if isinstance(t, T.DecimalType):
            return T.LongType() if t.scale == 0 and t.precision <= 18 else T.DoubleType()
        if isinstance(t, T.ArrayType):
            return T.ArrayType(plain(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(plain(t.keyType), plain(t.valueType), t.valueContainsNull)
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, plain(f.dataType), f.nullable) for f in t.fields])
        return t

    return df.select(*[F.col(f.name) if plain(f.dataType) == f.dataType
                       else F.col(f.name).cast(plain(f.dataType)).alias(f.name) for f in df.schema.fields])


def scan(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """S-01: a whole table, or only some of its columns."""
    df = spark.read.parquet(path)
    return clean_numbers(df.select(*fields) if fields else df)


def scan_jobs(spark: SparkSession, path: str, column: str, since: Column | int,
              fields: Sequence[str] | None = None) -> DataFrame:
    """S-02: rows made at or after a cut-off. The bare column is compared, so Parquet skips row groups."""
    df = spark.read.parquet(path)
    return clean_numbers((df.select(*fields) if fields else df).filter(F.col(column) >= since))
