"""Upload jobs: views, filters, joins and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.text import contains_text
from quaverlake.functions.times import DAY, day_date, local_day, next_reset, within
from quaverlake.operators.subscriptions import subscription_view

# Status groups, size classes in bytes, the free plan's and the paid plans' limits.
ACTIVE = ("uploading", "queued", "processing")
REMOVED = ("deleting", "deleted")
MIB = 1024 * 1024
SIZES = {"small": (0, MIB), "medium": (MIB, 10 * MIB), "large": (10 * MIB, None)}
QUEUE_SECONDS = 1800
MAX_ATTEMPTS = 3


def _zero(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))


def job_seconds(df: DataFrame) -> DataFrame:
    """P-06: queue to finish of done jobs. A republished job without a finish time has none."""
    finished = F.coalesce(F.nullif(F.col("finished_at"), F.lit(0)),
                          F.when(_zero("republished_at") == 0, F.col("updated_at")))
    ok = (F.col("status") == "done") & (_zero("queued_at") != 0) & (F.coalesce(finished, F.lit(0)) != 0)
    return df.withColumn("seconds", F.when(ok, finished - F.col("queued_at")))


def outcome_of(status: Column, reasons: Column) -> Column:
    return (F.when(status == "failed", "failed")
            .when((status == "done") & (F.coalesce(F.size(reasons), F.lit(0)) > 0), "warning")
            .when(status == "done", "done"))


def job_outcome(df: DataFrame) -> DataFrame:
    """P-07: failed, warning (done but needing review), done, or NULL while not finished."""
    return df.withColumn("outcome", outcome_of(F.col("status"), F.col("review_reasons")))


def real_uploads(df: DataFrame, demo_owner: str) -> DataFrame:
    """P-12: uploads of people, without the bundled demo's."""
    return df.filter(F.col("user_id") != demo_owner)


def with_sheet_name(jobs: DataFrame, sheets: DataFrame, demo_job: str | None = None,
                    demo_name: str | None = None) -> DataFrame:
    """J-01: the job's own name, else its sheet's. The sheets table grows with the jobs, so the
    join side is left to the optimiser's size check."""
    names = sheets.select("music_sheet_id", F.col("sheet_name").alias("__sheet"))
    name = F.coalesce(F.nullif(F.col("sheet_name"), F.lit("")), F.col("__sheet"))
    if demo_job is not None:
        name = F.when(F.col("job_id") == demo_job, F.lit(demo_name)).otherwise(name)
    return jobs.join(names, "music_sheet_id", "left").withColumn("sheet_name", name).drop("__sheet")


def with_guest(jobs: DataFrame, accounts: DataFrame) -> DataFrame:
    """J-02: whether the owner has no account."""
    ids = accounts.select("user_id").distinct().withColumn("__a", F.lit(True))
    return jobs.join(ids, "user_id", "left").withColumn("guest", F.col("__a").isNull()).drop("__a")


def with_copies(jobs: DataFrame) -> DataFrame:
    """J-05: other live rows made from the same content. Counts are combined before the shuffle
    and joined back, so a content shared by very many rows is never gathered."""
    live = (jobs.filter(F.col("content_sha256").isNotNull()
                        & ~F.coalesce(F.col("status").isin(*REMOVED), F.lit(False)))
            .groupBy("content_sha256").agg(F.count(F.lit(1)).alias("__n")))
    return (jobs.join(live, "content_sha256", "left")
            .withColumn("copies", F.greatest(F.lit(0), F.coalesce(F.col("__n"), F.lit(0)) - 1).cast("bigint"))
            .drop("__n"))


def uploads_per_user(jobs: DataFrame) -> DataFrame:
    """A-02: live uploads, failures and the last upload of each person."""
    return (jobs.filter(~F.coalesce(F.col("status").isin(*REMOVED), F.lit(False))).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("uploads"), F.count_if(F.col("status") == "failed").alias("failed"),
                 F.max(_zero("created_at")).alias("last_upload_at")))


def filter_uploads(df: DataFrame, now: int, q: str = "", sheet: str = "", owner: str = "", since: int = 0,
                   min_seconds: int = 0, size: str = "") -> DataFrame:
    """P-08 without the status: every other facet of the upload list."""
    keep = contains_text(F.col("user_id"), q) & within(F.col("created_at"), since, now)
    if owner:
        keep &= {"guest": F.col("guest"), "account": ~F.col("guest")}.get(owner, F.lit(True))
    if sheet:
        keep &= contains_text(F.concat_ws(" ", F.coalesce(F.col("sheet_name"), F.lit("")), F.col("job_id")), sheet)
    if min_seconds:
        keep &= _zero("seconds") >= min_seconds
    if size:
        low, high = SIZES.get(size, (0, None))
        keep &= _zero("size") >= low
        if high is not None:
            keep &= _zero("size") < high
    return df.filter(keep)


def filter_status(df: DataFrame, status: str = "") -> DataFrame:
    """P-08, the status facet: a job status, "active", or an outcome ("review" is "warning")."""
    if not status:
        return df
    if status == "active":
        return df.filter(F.col("status").isin(*ACTIVE))
    if status in ("done", "warning", "review"):
        return df.filter(F.col("outcome") == ("warning" if status == "review" else status))
    return df.filter(F.col("status") == status)


def uploads(df: DataFrame, now: int, status: str = "", **facets) -> DataFrame:
    """P-08: the upload list narrowed by all facets."""
    return filter_status(filter_uploads(df, now, **facets), status)


def outcome_summary(filtered: DataFrame) -> DataFrame:
    """A-13: outcomes over every filter but the status."""
    out = [F.count_if(F.col("outcome") == o).alias(o) for o in ("done", "warning", "failed")]
    return filtered.agg(*out).withColumn("processed", F.col("done") + F.col("warning") + F.col("failed"))


def overview(accounts: DataFrame, subscriptions: DataFrame, jobs: DataFrame, now: int) -> DataFrame:
    """A-01: the dashboard's figures in one row. Three single-row aggregates, joined on nothing.

    The median is exact; its state is one counter per distinct number of seconds.
    """
    def since(days: int) -> Column:
        return _zero("created_at") >= now - days * DAY

    users = accounts.agg(F.count(F.lit(1)).alias("users_total"), F.count_if(since(7)).alias("users_new_7d"),
                         F.count_if(since(30)).alias("users_new_30d"))
    premium = F.col("premium")
    subs = subscription_view(subscriptions, now).agg(
        F.count_if(premium).alias("premium"), F.count_if(premium & (F.col("status") == "trialing")).alias("trialing"),
        F.count_if(premium & F.col("cancel_at_period_end")).alias("canceling"),
        F.count_if(premium & (F.col("platform") == "stripe")).alias("stripe"),
        F.count_if(premium & (F.col("platform") == "apple")).alias("apple"), F.count_if(~premium).alias("ended"))
    recent, done = since(30), F.col("status") == "done"
    failed = F.col("status") == "failed"
    ups = job_seconds(jobs).agg(
        F.count(F.lit(1)).alias("uploads_total"), F.count_if(since(7)).alias("uploads_7d"),
        F.count_if(recent).alias("uploads_30d"), F.count_if(recent & failed).alias("failed_30d"),
        F.count_if(recent & done & (F.coalesce(F.size("review_reasons"), F.lit(0)) > 0)).alias("review_30d"),
        F.try_divide(F.count_if(recent & failed).cast("double"),
                     F.count_if(recent & (done | failed))).alias("failure_rate_30d"),
        F.median(F.when(recent & done, F.col("seconds"))).alias("median_seconds_30d"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("in_progress"))
    one = [d.withColumn("__one", F.lit(1)) for d in (users, subs, ups)]
    return one[0].join(one[1], "__one").join(one[2], "__one").drop("__one")


def workload(jobs: DataFrame, days: int) -> DataFrame:
    """A-15: the window's jobs in one row: rate, failures, retries, share on the new layout."""
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    finished = F.count_if(done | failed)
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"), (F.count(F.lit(1)) / F.lit(float(days))).alias("per_day"),
        F.try_divide(F.count_if(failed).cast("double"), finished).alias("failure_rate"),
        finished.alias("finished"), F.count_if(_zero("attempt_count") > 1).alias("retried"),
        F.count_if(_zero("storage_version") >= 2).alias("new_layout"))


def workload_statuses(jobs: DataFrame) -> DataFrame:
    """A-15: jobs per status, a missing status as unknown."""
    return (jobs.groupBy(F.coalesce(F.col("status"), F.lit("unknown")).alias("status"))
            .agg(F.count(F.lit(1)).alias("n")))


def readiness(df: DataFrame) -> DataFrame:
    """P-13: whether the original can be shown, and whether a failed job can be read again."""
    stored = (_zero("storage_version") == 2) & (F.coalesce(F.col("input_version"), F.lit("")) != "")
    return (df.withColumn("original_ready", (F.col("status") == "done")
                          | (stored & F.col("status").isin("queued", "processing", "failed")))
            .withColumn("can_retry", (F.col("status") == "failed") & stored))


def reprocess_view(jobs: DataFrame) -> DataFrame:
    """P-17: the last request to read a job again as a struct, NULL when there was none."""
    result = F.col("reprocess_result")
    empty = F.array().cast("array<string>")
    view = F.struct(F.col("reprocess_state").alias("state"), F.col("reprocess_requested_at").alias("requested_at"),
                    F.col("reprocess_finished_at").alias("finished_at"), F.col("reprocess_error").alias("error"),
                    F.coalesce(result["updated"], empty).alias("updated"),
                    F.coalesce(result["failed"], empty).alias("failed"))
    return jobs.withColumn("reprocess", F.when(F.coalesce(F.col("reprocess_state"), F.lit("")) != "", view))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """T-06: jobs not finished yet, oldest first."""
    return jobs.filter(F.col("status").isin(*ACTIVE)).orderBy(_zero("created_at"), "job_id")


def with_edits(jobs: DataFrame, edits: DataFrame) -> DataFrame:
    """J-36: jobs any reader has edited."""
    return jobs.join(edits.select("job_id").distinct(), "job_id", "left_semi")


def daily_starts(jobs: DataFrame, limits: DataFrame) -> DataFrame:
    """A-41: jobs started per person and UTC day against their limit (NULL: none)."""
    per_day = (jobs.withColumn("day", local_day(F.col("created_at")))
               .groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("started"),
                                              F.max(next_reset(F.col("created_at"))).alias("resets_at")))
    return (per_day.join(limits.select("user_id", "daily_limit"), "user_id", "left")
            .select("user_id", day_date(F.col("day")).alias("date"), "started", "daily_limit",
                    F.coalesce(F.col("started") >= F.col("daily_limit"), F.lit(False)).alias("at_limit"), "resets_at"))


def kept_sheets(jobs: DataFrame, entitlements: DataFrame, free_limit: int = 1) -> DataFrame:
    """A-42: kept sheets per person, and whether the free plan lets them add another."""
    gone = F.col("status").isin("failed", "deleting", "deleted")
    kept = jobs.groupBy("user_id").agg(F.count_if(~gone).alias("kept"))
    tier = entitlements.select("user_id", F.col("premium").alias("__p"))
    return (kept.join(tier, "user_id", "left").withColumn("premium", F.coalesce(F.col("__p"), F.lit(False)))
            .withColumn("blocked", ~F.col("premium") & (F.col("kept") >= free_limit)).drop("__p"))
