"""Subscription states, grants and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.functions.times import DAY

# States in report order, statuses that grant and that have ended.
STATES = ("active", "trial", "canceling", "past_due", "canceled")
GRANTING = ("active", "trialing")
ENDED = ("canceled", "expired")


def subscription_view(df: DataFrame, now: int) -> DataFrame:
    """P-03: adds ``premium``. A scheduled cancellation, and every store period that renews outside
    our sight, stops granting at its period end."""
    lapsed = ((F.coalesce(F.col("cancel_at_period_end"), F.lit(False)) | F.col("platform").eqNullSafe("apple"))
              & F.coalesce(F.col("current_period_end") <= now, F.lit(False)))
    return (df.withColumn("cancel_at_period_end", F.coalesce(F.col("cancel_at_period_end"), F.lit(False)))
            .withColumn("premium", F.coalesce(F.col("status").isin(*GRANTING), F.lit(False)) & ~lapsed))


def state_of(premium: Column, cancel: Column, status: Column) -> Column:
    """P-04: one state each, so that counts add up."""
    return (F.when(premium & cancel, "canceling").when(premium & (status == "trialing"), "trial")
            .when(premium, "active").when(status == "past_due", "past_due").otherwise("canceled"))


def subscription_state(df: DataFrame) -> DataFrame:
    """P-04 over the result of :func:`subscription_view`."""
    return df.withColumn("state", state_of(F.col("premium"), F.col("cancel_at_period_end"), F.col("status")))


def subscription_counts(df: DataFrame) -> DataFrame:
    """A-12: rows per state, states without rows kept."""
    spark = df.sparkSession
    names = spark.createDataFrame([(s, i) for i, s in enumerate(STATES)], "state string, position int")
    counts = df.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return (names.join(counts, "state", "left")
            .select("state", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"), "position")
            .orderBy("position").drop("position"))


def gate_updates(updates: DataFrame, current: DataFrame, now: int) -> DataFrame:
    """J-23: an update is accepted unless another subscription is active on the account.

    Rejected rows stay, with their reason.
    """
    held = subscription_view(current, now).select(
        F.col("user_id"), F.col("platform").alias("__p"), F.col("subscription_id").alias("__s"),
        F.col("premium").alias("__active"))
    same = F.col("platform").eqNullSafe(F.col("__p")) & F.col("subscription_id").eqNullSafe(F.col("__s"))
    blocked = F.coalesce(F.col("__active"), F.lit(False)) & ~same
    return (updates.join(held, "user_id", "left")
            .withColumn("accepted", ~blocked)
            .withColumn("reason", F.when(blocked, "another subscription is active"))
            .drop("__p", "__s", "__active"))


def fold_events(events: DataFrame, chunk_seconds: int = 30 * DAY) -> DataFrame:
    """ST-06 in batch: the current row of every account from its updates in time order.

    ``events``: user_id, at, seq, status, plan, platform, subscription_id, started_at,
    current_period_start/end, cancel_at_period_end, canceled_at, ended_at. Optional identities keep
    their last given value. A cancellation time is the provider's own when it sent one, else the
    first time heard; it is dropped when the subscriber resumes. That is a run of applying updates:
    the last run decides, with its last provider time, or its first update's time. Where ``events`` has ``updated_at`` (a stored row), it counts
    besides ``at``.

    Events are read once: stretches of ``chunk_seconds`` of an account are reduced in one task each, and the few rows that are left decide.
    """
    applies = {"canceled_at": F.coalesce(F.col("cancel_at_period_end"), F.lit(False)) | F.coalesce(F.col("status").isin(*ENDED), F.lit(False)),
               "ended_at": F.coalesce(F.col("status").isin(*ENDED), F.lit(False))}
    told = F.coalesce(F.col("updated_at"), F.col("at")) if "updated_at" in events.columns else F.col("at")
    rank = F.struct("at", "seq")
    rows = events.withColumns({"__rank": rank, "__told": told, "__chunk": F.floor(F.col("at") / chunk_seconds), **{f"__on_{f}": on for f, on in applies.items()}})
    inside = Window.partitionBy("user_id", "__chunk").orderBy("at", "seq")
    # A run that starts inside the chunk: its first update follows one that does not apply.
    rows = rows.withColumns({f"__starts_{f}": F.col(f"__on_{f}") & ~F.lag(f"__on_{f}", 1, True).over(inside) for f in applies})
    always = ("status", "plan", "platform", "current_period_start", "current_period_end", "cancel_at_period_end")
    given = ("subscription_id", "started_at")

    def last(value: Column, where: Column, name: str) -> Column:
        return F.max(F.when(where, F.struct(F.col("__rank").alias("r"), value.alias("v")))).alias(name)

    parts = rows.groupBy("user_id", "__chunk").agg(
        F.max(F.struct("__rank", *always)).alias("__latest"), F.max("__told").alias("__told"), *[last(F.col(c), F.col(c).isNotNull(), c) for c in given],
        *[x for f in applies for x in (
            F.max(F.when(~F.col(f"__on_{f}"), F.col("__rank"))).alias(f"__reset_{f}"), F.min(F.when(F.col(f"__on_{f}"), F.col("__rank"))).alias(f"__first_{f}"),
            F.max(F.when(F.col(f"__starts_{f}"), F.col("__rank"))).alias(f"__tail_{f}"),
            last(F.col(f), F.col(f"__on_{f}") & F.col(f).isNotNull() & (F.col(f) != 0), f"__given_{f}"))])
    whole = Window.partitionBy("user_id")
    parts = parts.withColumns({f"__off_{f}": F.max(f"__reset_{f}").over(whole) for f in applies})

    def after(f: str, value: Column, place: Column) -> Column:
        return F.when(F.col(f"__off_{f}").isNull() | (place > F.col(f"__off_{f}")), value)

    out = parts.groupBy("user_id").agg(
        F.max("__latest").alias("__latest"), F.max("__told").alias("updated_at"), *[F.max(c).alias(c) for c in given],
        *[x for f in applies for x in (
            F.min(F.least(after(f, F.col(f"__first_{f}.at"), F.col(f"__first_{f}")), after(f, F.col(f"__tail_{f}.at"), F.col(f"__tail_{f}")))).alias(f"__start_{f}"),
            F.max(after(f, F.col(f"__given_{f}"), F.col(f"__given_{f}.r"))).alias(f"__given_{f}"))])
    return out.select("user_id", *[F.col(f"__latest.{c}").alias(c) for c in always], *[F.col(f"{c}.v").alias(c) for c in given], "updated_at",
                      *[F.coalesce(F.col(f"__given_{f}.v"), F.col(f"__start_{f}")).alias(f) for f in applies])


__all__ = ["STATES", "GRANTING", "ENDED", "subscription_view", "state_of", "subscription_state",
           "subscription_counts", "gate_updates", "fold_events"]
