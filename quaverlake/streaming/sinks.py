"""Running streams over finite input and reading their results back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quaverlake.session import checkpoint_dir


def stream_root(spark: SparkSession) -> str:
    """A new folder for one stream's checkpoint and table, in the shared folder the cluster names."""
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, output: str = "append", keys: tuple[str, ...] = (), root: str | None = None) -> DataFrame:
    """Process all input there is and return the written table.

    Append results go to a file sink. Update results are written once per micro-batch under its number,
    so a batch that runs again replaces itself; the newest row of a key is its value, of one batch the expired one if there is such a row.
    With the ``root`` of an earlier run the stream goes on where that one stopped.
    """
    spark = stream.sparkSession
    root = root or stream_root(spark)
    table, state = f"{root}/table", f"{root}/state"
    if output == "append":
        q = (stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(table)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode("update")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", table).parquet(table)
    rank = F.struct("batch", "expired") if "expired" in stream.columns else F.col("batch")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), rank).alias("__r"))
    return newest.select("__r.*")
