"""Content matching: copies of one file, reuse of earlier results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.settings import DRAWING, READING, settings_equal
from quaverlake.operators.ranks import top_n_per_key
from quaverlake.operators.uploads import REMOVED


def content_hash(content: Column) -> Column:
    """F-17: SHA-256 of the content, in hexadecimal."""
    return F.sha2(content, 256)


def sort_key(created_at: Column, job_id: Column) -> Column:
    """Sort key of a processed row: newest last in text order."""
    return F.concat(F.format_string("%012d", created_at), F.lit("#"), job_id)


def fill_hashes(jobs: DataFrame, sources: DataFrame, content: str) -> DataFrame:
    """J-06, first half: hash the rows without a hash whose size occurs among the sources.

    The size test is a semi join, so content of other sizes is never hashed.
    """
    missing = jobs.filter(F.col("content_sha256").isNull())
    sizes = sources.select(F.col("size").alias("__size")).distinct()
    wanted = missing.join(sizes, F.col("size") == F.col("__size"), "left_semi")
    hashed = wanted.withColumn("content_sha256", content_hash(F.col(content)))
    return jobs.filter(F.col("content_sha256").isNotNull()).unionByName(hashed)


def matching(sources: DataFrame, jobs: DataFrame, content: str | None = None) -> DataFrame:
    """J-06: per source row (``source_id``, ``content_sha256``, ``size``), every other live row made
    from the same content, with its place by age. The source side is the short list of rows asked
    about; the output is as long as the matches are many."""
    pool = jobs.filter((F.col("storage_version") == 2) & ~F.coalesce(F.col("status").isin(*REMOVED), F.lit(False)))
    if content is not None:
        pool = fill_hashes(pool, sources, content)
    asked = sources.select("source_id", "content_sha256")
    return (pool.join(asked, "content_sha256").filter(F.col("job_id") != F.col("source_id"))
            .select("source_id", "job_id", "content_sha256", F.coalesce("created_at", F.lit(0)).alias("created_at")))


def content_classes(jobs: DataFrame, content: str | None = None) -> DataFrame:
    """J-06 for all rows at once: every live row with the class of rows made from the same content.

    (job_id, content_sha256, class_id, copies): ``class_id`` is the oldest member, ``copies`` the number of other members. Rows without a hash are hashed
    where their size occurs among those that have one; the rest are classes of their own. Classes are counted by a combined aggregate and
    joined back, so a content with a third of all rows makes one row for each of its members, not all pairs.
    """
    pool = jobs.filter((F.col("storage_version") == 2) & ~F.coalesce(F.col("status").isin(*REMOVED), F.lit(False)))
    if content is not None:
        sizes = jobs.filter(F.col("content_sha256").isNotNull()).select(F.col("size").alias("__size")).distinct()
        pool = pool.join(sizes, F.col("size") == F.col("__size"), "left").withColumn(
            "content_sha256", F.coalesce("content_sha256", F.when(F.col("__size").isNotNull(), content_hash(F.col(content)))))
    age = F.struct(F.coalesce("created_at", F.lit(0)), F.col("job_id"))
    classes = pool.groupBy("content_sha256").agg(F.min_by("job_id", age).alias("class_id"), (F.count(F.lit(1)) - 1).alias("copies"))
    return (pool.select("job_id", "content_sha256").join(classes.filter(F.col("content_sha256").isNotNull()), "content_sha256", "left")
            .select("job_id", "content_sha256", F.coalesce("class_id", "job_id").alias("class_id"), F.coalesce("copies", F.lit(0)).alias("copies")))


def find_reuse(uploads: DataFrame, processed: DataFrame, jobs: DataFrame, cache_epoch: int, lookup: int | None,
               region: str | None = None) -> DataFrame:
    """J-07: the earlier result each upload can use: an exact one is copied, else the newest that
    can be drawn again.

    With ``lookup`` only that many newest rows of a content are looked at, as a store's lookup may define; they are cut per content before the
    shuffle. With None all are: the newest of each content, settings and drawability is then kept by a combined aggregate, which is
    the only one of them that could be chosen (and the one before it, for an upload that is itself the newest), so a content with a third of all rows
    costs no more than any other.
    """
    newest = processed if lookup is None else top_n_per_key(processed, ["content_sha256"], [F.col("sort").desc()], lookup, "__place")
    usable = newest.filter(F.col("cache_epoch") == cache_epoch)
    if region is not None:
        usable = usable.filter(F.col("files_region").eqNullSafe(region))
    live = jobs.filter((F.col("status") == "done") & F.col("output_key").isNotNull()).select(
        F.col("job_id").alias("source_id"), F.col("content_sha256").alias("__hash"),
        F.col("notes_key").isNotNull().alias("__redrawable"))
    rows = (usable.select("content_sha256", "sort", F.col("job_id").alias("source_id"), F.col("settings").alias("__made"))
            .join(live, "source_id").filter(F.col("__hash") == F.col("content_sha256")).drop("__hash"))
    if lookup is None:
        # Rows of one content made alike are interchangeable but for their age; an upload never reuses itself, so two of them are enough.
        rows = top_n_per_key(rows, ["content_sha256", "__made", "__redrawable"], [F.col("sort").desc()], 2, "__place").drop("__place")
    exact = settings_equal(F.col("__made"), F.col("settings"), DRAWING)
    pairs = (uploads.select("job_id", "content_sha256", "settings").join(rows, "content_sha256")
             .filter((F.col("job_id") != F.col("source_id"))
                     & settings_equal(F.col("__made"), F.col("settings"), READING))
             .withColumn("exact", exact).filter(F.col("exact") | F.col("__redrawable")))
    best = pairs.groupBy("job_id").agg(F.max_by(F.struct("source_id", "exact"), F.struct("exact", "sort")).alias("b"))
    return best.select("job_id", "b.source_id", F.when(F.col("b.exact"), "copied").otherwise("redrawn").alias("how"))


def prune_processed(processed: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-08: (valid rows, rows to drop). Valid: the source is done and still made from that content.
    To drop: the source is gone or going. A row whose source is busy is in neither."""
    done = jobs.filter(F.col("status") == "done").select("job_id", "content_sha256")
    there = jobs.filter(~F.coalesce(F.col("status").isin(*REMOVED), F.lit(False))).select("job_id")
    return (processed.join(done, ["job_id", "content_sha256"], "left_semi"),
            processed.join(there, "job_id", "left_anti"))


__all__: Sequence[str] = ["content_hash", "sort_key", "fill_hashes", "matching", "find_reuse", "prune_processed"]
