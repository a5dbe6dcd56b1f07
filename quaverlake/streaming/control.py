"""Quotas, job lifecycle, subscriptions, duplicate messages and document revisions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions.times import DAY, day_date, local_day
from quaverlake.operators.asof import asof_next
from quaverlake.operators.segments import row_index
from quaverlake.operators.subscriptions import fold_events
from quaverlake.operators.uploads import MAX_ATTEMPTS, QUEUE_SECONDS
from quaverlake.session import cut_lineage
from quaverlake.streaming.versioned import VersionedTable


def quota(starts: DataFrame, limits: DataFrame, order: Sequence[str] = ("at", "seq"), chunk_seconds: int = 3600) -> DataFrame:
    """ST-05 in batch: starts per person and UTC day in order of arrival; those past the limit are refused.

    A refused start does not count, so the first ``daily_limit`` are the accepted ones. Days are cut into
    hours, so one very busy person is counted in parallel.
    """
    s = starts.withColumn("day", local_day(F.col("at")))
    s = row_index(s, ["user_id", "day"], list(order), "nth", F.floor(F.col("at") / chunk_seconds).cast("bigint"))
    s = s.join(limits.select("user_id", "daily_limit"), "user_id", "left")
    return s.withColumn("accepted", F.coalesce(F.col("nth") <= F.col("daily_limit"), F.lit(True)))


def quota_counts(starts: DataFrame, watermark: str = "1 day") -> DataFrame:
    """ST-05 as a stream: started sheets per person and UTC day; a day's counter expires a day after it."""
    counted = (starts.withWatermark("at_ts", watermark).groupBy(F.window("at_ts", "1 day").alias("w"), "user_id")
               .agg(F.count(F.lit(1)).alias("sheets")))
    day = F.unix_seconds("w.start")
    return counted.select("user_id", day_date(local_day(day)).alias("date"), "sheets", (day + 2 * DAY).alias("expires_at"))


def fold_into(state: DataFrame, updates: DataFrame) -> DataFrame:
    """ST-06 for a micro-batch: the table after applying updates in order; a stored row acts as its
    person's earliest update, so a cancellation time first heard stays."""
    base = state.select("user_id", F.lit(-1).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("seq"), "updated_at",
                        *[c for c in updates.columns if c not in ("user_id", "at", "seq")])
    return fold_events(base.unionByName(updates.withColumn("updated_at", F.col("at"))))


def subscription_table(updates: DataFrame, root: str, buckets: int = 64, keep: int = 3) -> VersionedTable:
    """ST-06 as a stream: every micro-batch of updates is folded into a table of one row for each account, in versions by batch number.

    All updates there are are applied; with the same ``root`` a later run goes on. A batch that runs again changes nothing.
    """
    spark = updates.sparkSession
    table = VersionedTable(spark, f"{root}/table", fold_events(spark.createDataFrame([], updates.schema)).schema, ("user_id",), buckets, keep)
    query = (updates.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number, fold_into)).option("checkpointLocation", f"{root}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return table


# --- jobs --------------------------------------------------------------------------------------------

def lifecycle(events: DataFrame) -> DataFrame:
    """ST-07: the state of every job from its events (job_id, at, seq, status): last status, attempts, queued
    last, finished first."""
    rank = F.struct("at", "seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", rank).alias("status"), F.count_if(F.col("status") == "processing").alias("attempts"),
        F.max(F.when(F.col("status") == "queued", F.col("at"))).alias("queued_at"),
        F.min(F.when(F.col("status").isin("done", "failed"), F.col("at"))).alias("finished_at"), F.max("at").alias("updated_at"))


def due_actions(jobs: DataFrame, now: int, queue_seconds: int = QUEUE_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """ST-08: what is to be done with every job whose check is due."""
    s = F.col("status")
    lapsed = F.coalesce("lease_until", F.lit(0)) <= now
    waited = F.coalesce("queued_at", "created_at") + queue_seconds <= now
    spent = F.coalesce("attempt_count", F.lit(0)) >= max_attempts
    action = (F.when(s.isin("done", "failed", "deleted"), "release").when(s == "deleting", "finish delete")
              .when((s == "uploading") & (F.col("upload_expires_at") < now), "fail: upload expired").when(s == "uploading", "check later")
              .when((s == "processing") & lapsed & spent, "fail: unreadable").when((s == "processing") & lapsed, "requeue")
              .when((s == "queued") & spent, "fail: unreadable").when((s == "queued") & waited, "fail: not started")
              .when(s == "queued", "send again"))
    return jobs.filter((F.col("storage_version") == 2) & (F.col("next_check_at") <= now)).withColumn("action", action).filter(
        F.col("action").isNotNull())


def alerts(jobs: DataFrame, quality: DataFrame) -> DataFrame:
    """ST-12: finished jobs that need review and failed attempts, each with its reasons. ``jobs`` may be a
    stream; ``quality`` (job_id, reasons) is a table."""
    j = jobs.join(quality.select("job_id", "reasons"), "job_id", "left")
    done = (F.col("status") == "done") & (F.coalesce(F.size("reasons"), F.lit(0)) > 0)
    failed = F.col("status") == "failed"
    return (j.filter(done | failed).withColumn("event", F.when(failed, "job_failed").otherwise("job_done"))
            .withColumn("reasons", F.when(failed, F.array(F.coalesce("error", F.lit("unknown error")))).otherwise(F.col("reasons"))))


def alert_stream(jobs: DataFrame, quality: Callable[[SparkSession], DataFrame], root: str) -> DataFrame:
    """ST-12 as a stream: the alerts of all jobs there are, each micro-batch against ``quality`` as it is then.

    ``quality`` is called anew for each micro-batch, so the table that it reads may grow and change between them. A batch is written under its
    number; one that runs again replaces itself.
    """
    spark = jobs.sparkSession
    kind = alerts(jobs, quality(spark)).schema

    def write(batch: DataFrame, number: int) -> None:
        alerts(batch, quality(batch.sparkSession)).write.mode("overwrite").parquet(f"{root}/alerts/batch={number}")

    query = jobs.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(kind).parquet(f"{root}/alerts/batch=*")


# --- messages and documents --------------------------------------------------------------------------

def dedup_messages(stream: DataFrame, keys: Sequence[str] = ("job_id", "version"), time: str = "arrived", within: str = "14 days") -> DataFrame:
    """ST-11: a message delivered again changes nothing: later copies within the time are dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def dedup_messages_batch(messages: DataFrame, keys: Sequence[str] = ("job_id", "version"), order: Sequence[str] = ("arrived", "seq")) -> DataFrame:
    """ST-11 in batch: the first delivery of each message, by a combined aggregate."""
    return messages.groupBy(*keys).agg(F.min_by(F.struct(*messages.columns), F.struct(*order)).alias("m")).select("m.*")


def accept_revisions(saves: DataFrame, keys: Sequence[str] = ("job_id", "user_id"), chunk_width: float | None = None) -> DataFrame:
    """ST-13: a save (``seq`` its arrival, ``revision`` what it was based on) is accepted on the current revision.

    The save that follows an accepted one is the first later save based on the next revision, so every save
    has one possible successor; the accepted ones are those reached from the first save on revision 0.
    Reaching doubles its stride each round. Refused saves stay, marked.
    """
    ask = saves.select(*keys, "seq", (F.col("revision") + 1).alias("revision"))
    given = saves.select(*keys, "revision", "seq", F.col("seq").alias("__next"))
    jump = asof_next(ask, given, [*keys, "revision"], "seq", ["__next"], chunk_width=chunk_width)
    jump = cut_lineage(jump.filter(F.col("__next").isNotNull()).select(*keys, F.col("seq").alias("a"), F.col("__next").alias("b")))
    reached = cut_lineage(saves.filter(F.col("revision") == 0).groupBy(*keys).agg(F.min("seq").alias("a")))
    while True:
        fresh = cut_lineage(reached.join(jump, [*keys, "a"]).select(*keys, F.col("b").alias("a")).join(reached, [*keys, "a"], "left_anti"))
        if fresh.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(fresh))
        hop = jump.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
        jump = cut_lineage(jump.join(hop, [*keys, "b"]).select(*keys, "a", F.col("c").alias("b")))
    ok = reached.select(*keys, F.col("a").alias("seq"), F.lit(True).alias("__ok"))
    return saves.join(ok, [*keys, "seq"], "left").withColumn("accepted", F.coalesce("__ok", F.lit(False))).drop("__ok")
