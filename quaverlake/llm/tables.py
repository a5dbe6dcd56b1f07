"""Steps written to the shared folder, and joins whose small side is broadcast only when its measured size is small."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.session import checkpoint_dir, ship_package

#: Largest side that is sent to every executor, in bytes of its Parquet files.
BROADCAST_BYTES = 16 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def shared_path(spark: SparkSession) -> str:
    """A new folder name below the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/step-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends here, and a lost executor costs no earlier work."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table made by ``written``; the plan of a plain file scan knows them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its files are small; a larger one is joined by a shuffle, with the same rows."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a table in the shared folder, in as many buckets of ``key`` as the session has shuffle partitions: a join on ``key`` shuffles
    only its other side. The catalogue forgets the table at once, its files stay."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", shared_path(spark)).bucketBy(count, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def settled(spark: SparkSession) -> None:
    """Gives the driver's unused heap back to the system: plans and broadcasts of steps that are done are only freed by a full collection,
    and a heap that once grew stays large without one."""
    gc.collect()  # what Python let go of is held by the JVM until then
    spark.sparkContext._jvm.System.gc()


def _tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives memory back to the system after each batch and each task, since workers live on beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        pool, trim = pa.default_memory_pool(), getattr(ctypes.CDLL(None), "malloc_trim", None)

        def one_by_one() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                pool.release_unused()

        yield from work(one_by_one())
        pool.release_unused()
        if trim is not None:
            trim(0)

    return run


def map_batches(df: DataFrame, columns: list, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over Arrow batches of just the named columns.

    Texts are long, so batches have ``BATCH_ROWS`` rows where the session has Spark's own setting; another setting stays.
    """
    session = df.sparkSession
    ship_package(session)
    if session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.select(*columns).mapInArrow(_tidied(work), schema)
