"""A keyed table in versions: each micro-batch writes the buckets that it touches and then one small manifest that says where every bucket lies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Fold = Callable[[DataFrame, DataFrame], DataFrame]


class VersionedTable:
    """A table under ``path`` whose rows are dealt to ``buckets`` by their key.

    A version is the number of the micro-batch that made it. Its manifest is written last: until then readers see the version before, and a batch
    that broke off leaves nothing that is read. A batch that runs again starts from the version before its own, so it changes nothing. Only the
    buckets of keys in the batch are read and written. The ``keep`` newest versions can be read; what only older ones point to is removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...], buckets: int = 64, keep: int = 3):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), schema, keys, buckets, keep

    def _entries(self, path: str) -> list[tuple[int, bool]]:
        """(number, committed) of the ``batch=<number>`` folders below a path."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("batch=")]
        return sorted((int(p.getName()[6:]), fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))) for p in found)

    def _drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def versions(self) -> list[int]:
        return [n for n, whole in self._entries(f"{self.path}/manifest") if whole]

    def _places(self, version: int | None) -> dict[int, int]:
        """The batch that wrote each bucket last: at most ``buckets`` numbers."""
        if version is None:
            return {}
        return {r.bucket: r.written for r in self.spark.read.schema("bucket int, written long").parquet(f"{self.path}/manifest/batch={version}").collect()}

    def _rows(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(places.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the newest one if none is given."""
        known = self.versions()
        return self._rows(self._places(version if version is not None else max(known, default=None)))

    def apply(self, updates: DataFrame, batch: int, fold: Fold) -> None:
        """``fold(rows, updates)`` for the buckets that ``updates`` touch, as version ``batch``."""
        base = max((n for n in self.versions() if n < batch), default=None)
        places = self._places(base)
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets)).cast("int")
        updates = updates.persist()
        try:
            touched = [r.bucket for r in updates.select(bucket.alias("bucket")).distinct().collect()]
            if touched:
                new = fold(self._rows({b: places[b] for b in touched if b in places}), updates).select(*self.schema.names)
                # One task a bucket, so a version has one file for each bucket that it touches.
                dealt = new.withColumn("bucket", bucket).repartition(min(len(touched), self.buckets), "bucket")
                dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
                # A bucket that a fold leaves empty has no folder.
                kept = {r.bucket for r in self.spark.read.parquet(f"{self.path}/data/batch={batch}").select("bucket").distinct().collect()}
                places = {b: n for b, n in places.items() if b not in touched} | dict.fromkeys(kept, batch)
            manifest = self.spark.createDataFrame(sorted(places.items()), "bucket int, written long").coalesce(1)
            manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        finally:
            updates.unpersist()
        self._forget()

    def _forget(self) -> None:
        known = self.versions()
        needed = {n for v in known[-self.keep:] for n in self._places(v).values()}
        for v in known[:-self.keep]:
            self._drop(f"{self.path}/manifest/batch={v}")
        for n, _ in self._entries(f"{self.path}/data"):
            if n not in needed and n < known[-1]:
                self._drop(f"{self.path}/data/batch={n}")
