"""Accounts, sign-ups and master grants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.text import contains_text
from quaverlake.functions.times import DAY, day_date, day_span, day_spine, local_day, within
from quaverlake.operators.subscriptions import state_of, subscription_view
from quaverlake.operators.uploads import uploads_per_user

# Where an account can be made.
SIGNUP_PLATFORMS = ("web", "ios")


def known_platform(col: Column) -> Column:
    """Where the account was made, NULL when not recorded or not known."""
    return F.when(col.isin(*SIGNUP_PLATFORMS), col)


def activity_per_user(sessions: DataFrame, now: int) -> DataFrame:
    """A-03: active seconds of the last 30 days and the last time seen."""
    recent = F.col("started_at") >= now - 30 * DAY
    return sessions.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(recent, F.col("seconds"))), F.lit(0)).cast("bigint").alias("active_seconds_30d"),
        F.max("last_at").alias("last_active_at"))


def effective_plan(df: DataFrame) -> DataFrame:
    """P-05: a granting subscription, else a master grant, else an ended subscription, else free."""
    return df.withColumn("plan_shown", F.when(F.coalesce(F.col("premium"), F.lit(False)), F.col("state"))
                         .when(F.col("master"), "master").otherwise(F.coalesce(F.col("state"), F.lit("free"))))


def users_rollup(accounts: DataFrame, subscriptions: DataFrame, masters: DataFrame, jobs: DataFrame,
                 sessions: DataFrame, now: int) -> DataFrame:
    """J-03: one row per account with its subscription, grant, uploads and activity.

    All sides are reduced to one row per account before the joins, which share one key.
    """
    subs = (subscription_view(subscriptions, now)
            .select("user_id", "status", "premium", F.col("started_at").alias("sub_started_at"),
                    F.col("canceled_at").alias("sub_canceled_at"),
                    state_of(F.col("premium"), F.col("cancel_at_period_end"), F.col("status")).alias("state")))
    grants = masters.select("user_id").distinct().withColumn("master", F.lit(True))
    rows = (accounts.select("user_id", "created_at", known_platform(F.col("signup_platform")).alias("signup_platform"))
            .join(subs, "user_id", "left").join(grants, "user_id", "left")
            .join(uploads_per_user(jobs), "user_id", "left")
            .join(activity_per_user(sessions, now), "user_id", "left"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("uploads", "failed", "active_seconds_30d")}
    return effective_plan(rows.withColumns({"master": F.coalesce(F.col("master"), F.lit(False)), **zero}))


def users(rollup: DataFrame, now: int, q: str = "", joined: int = 0, plan: str = "", subscribed: int = 0,
          canceled: int = 0, uploads: str = "", platform: str = "") -> DataFrame:
    """P-09: the roll-up narrowed by any of its facets."""
    keep = contains_text(F.col("user_id"), q) & within(F.col("created_at"), joined, now)
    if platform:
        keep &= F.coalesce(F.col("signup_platform"), F.lit("unknown")) == platform
    if plan:
        keep &= F.col("plan_shown") == plan
    if subscribed:
        keep &= F.col("status").isNotNull() & within(F.col("sub_started_at"), subscribed, now)
    if canceled:
        keep &= (F.coalesce(F.col("sub_canceled_at"), F.lit(0)) != 0) & within(F.col("sub_canceled_at"), canceled, now)
    if uploads:
        keep &= {"none": F.col("uploads") == 0, "some": F.col("uploads") > 0, "failed": F.col("failed") > 0}.get(
            uploads, F.lit(True))
    return rollup.filter(keep)


def masters_listing(grants: DataFrame, accounts: DataFrame) -> DataFrame:
    """J-04: every grant, with its account where there is one."""
    acc = accounts.select("user_id", "created_at", known_platform(F.col("signup_platform")).alias("signup_platform"),
                          F.lit(True).alias("account"))
    return (grants.join(acc, "user_id", "left")
            .withColumn("account", F.coalesce(F.col("account"), F.lit(False))))


def ids_with_email(accounts: DataFrame, email: str) -> DataFrame:
    """P-11: ids that sign in with an address; the address itself never leaves."""
    return accounts.filter(F.lower(F.trim("email")) == email.strip().lower()).select("user_id")


def split_grants(ids: DataFrame, accounts: DataFrame, grants: DataFrame) -> DataFrame:
    """D-05: requested ids as granted, already (granted before) or refused (no account)."""
    acc = accounts.select("user_id").distinct().withColumn("__a", F.lit(True))
    has = grants.select("user_id").distinct().withColumn("__g", F.lit(True))
    outcome = (F.when(F.col("__a").isNull(), "refused").when(F.col("__g").isNotNull(), "already")
               .otherwise("granted"))
    return (ids.select("user_id").distinct().join(acc, "user_id", "left").join(has, "user_id", "left")
            .select("user_id", outcome.alias("outcome")))


def signups(accounts: DataFrame, now: int, days: int, offset: int, longest: int) -> DataFrame:
    """A-10: accounts made per local day, split by platform, every day present; ``longest`` bounds the days that may be asked for."""
    first, last = day_span(now, days, offset, longest)
    split = F.coalesce(known_platform(F.col("signup_platform")), F.lit("unknown"))
    names = [*SIGNUP_PLATFORMS, "unknown"]
    per_day = (accounts.filter(F.coalesce(F.col("created_at"), F.lit(0)) != 0)
               .withColumn("day", local_day(F.col("created_at"), offset))
               .filter(F.col("day").between(first, last)).withColumn("__p", split)
               .groupBy("day").agg(F.count(F.lit(1)).alias("count"),
                                   *[F.count_if(F.col("__p") == n).alias(n) for n in names]))
    spine = day_spine(accounts.sparkSession, now, days, offset, longest)
    return (spine.join(per_day, "day", "left").orderBy("day")
            .select(day_date(F.col("day")).alias("date"),
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("count", *names)]))


def signup_totals(days: DataFrame) -> DataFrame:
    """A-11: the whole span's sign-ups, in total and per platform."""
    names = [*SIGNUP_PLATFORMS, "unknown"]
    long = days.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("platform", "n"))
    return (long.rollup("platform").agg(F.sum("n").cast("bigint").alias("n"), F.grouping("platform").alias("g"))
            .select(F.when(F.col("g") == 1, "total").otherwise(F.col("platform")).alias("platform"), "n"))


def people_split(sessions: DataFrame, accounts: DataFrame) -> DataFrame:
    """D-01: the people seen, with and without an account."""
    seen = sessions.select("user_id").distinct()
    ids = accounts.select("user_id").distinct()
    return (seen.intersect(ids).withColumn("kind", F.lit("account"))
            .unionByName(seen.exceptAll(ids).withColumn("kind", F.lit("guest"))))


def forget(df: DataFrame, ids: DataFrame, key: str = "user_id") -> DataFrame:
    """D-04: the table without every row of the given people."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def merge_settings(rows: DataFrame, keys: Sequence[str], settings: str, order: Sequence[str]) -> DataFrame:
    """D-03: per person, the union of setting maps in time order: the last non-NULL value of a key wins.

    The maps are taken apart first, so the state of a group is one value per setting, however many
    updates a person made.
    """
    parts = (rows.select(*keys, *order, F.explode(settings).alias("__k", "__v")).filter(F.col("__v").isNotNull())
             .groupBy(*keys, "__k").agg(F.max_by("__v", F.struct(*order)).alias("__v")))
    return parts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(settings))
