"""Logical tables bound to the benchmark's Parquet tables.

Each function reads only the columns it needs, so Parquet column pruning works through it.
``JOBS_NOW`` and ``EVENTS_NOW`` stand in for the clock, which no operator reads.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions.times import DAY, to_epoch
from quaverlake.operators.segments import row_index

JOBS_NOW = 996796800  # 2001-08-03, after the last order
EVENTS_NOW = 1706659200  # 2024-01-31, after the last event

#: Control names for the five event types of the events table.
CONTROL_OF_TYPE = {"view": "view", "click": "play", "purchase": "paywall", "signup": "speed", "error": "edit"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recode(col, mapping: dict[str, str]):
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customers in three hold an account; the rest are guests."""
    first = (table(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("first_order")))
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 != 0)
    return (c.join(first, c.c_custkey == first.o_custkey, "left")
            .select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("email"),
                    to_epoch(F.col("first_order")).alias("created_at"),
                    _recode(F.col("c_mktsegment"), {"BUILDING": "web", "MACHINERY": "ios", "AUTOMOBILE": "desktop"})
                    .alias("signup_platform")))


def account_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 != 0)
            .select(F.col("c_custkey").cast("string").alias("user_id")))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as upload jobs; the lines give the finish time and the review reasons."""
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.max("l_shipdate").alias("last_ship"),
                  F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"),
                  F.count(F.lit(1)).alias("n_lines")))
    o = job_heads(spark, sf_dir)
    return (o.join(lines, F.col("job_key") == F.col("l_orderkey"), "left")
            .withColumn("finished_at", to_epoch(F.col("last_ship")))
            .withColumn("updated_at", F.coalesce(F.col("finished_at"), F.col("created_at") + 3600))
            .withColumn("review_reasons", F.when(F.col("returned") == 1, F.array(F.lit("returned")))
                        .otherwise(F.array().cast("array<string>")))
            .withColumn("attempt_count", F.coalesce(F.col("n_lines"), F.lit(0)).cast("bigint"))
            .drop("l_orderkey", "last_ship", "returned", "n_lines"))


def job_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the jobs table that needs no lines."""
    return job_heads_of(table(spark, sf_dir, "orders"))


def job_heads_of(o: DataFrame) -> DataFrame:
    """``job_heads`` of orders, which may be a stream."""
    made = to_epoch(F.col("o_orderdate"))
    low = F.col("o_orderpriority") == "5-LOW"
    medium = F.col("o_orderpriority") == "3-MEDIUM"
    status = (F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed")
              .when(low, "deleted").when(medium, "processing").otherwise("queued"))
    return o.select(
        F.col("o_orderkey").alias("job_key"), F.col("o_orderkey").cast("string").alias("job_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        (F.col("o_orderkey") % 2500).cast("string").alias("music_sheet_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT",
               F.concat(F.lit("Urgent "), F.col("o_orderkey").cast("string"))).alias("sheet_name"),
        status.alias("status"), made.alias("created_at"), made.alias("queued_at"),
        F.when(F.col("o_orderpriority") == "2-HIGH", made + 7200).alias("republished_at"),
        F.floor(F.col("o_totalprice") * 40).cast("bigint").alias("size"),
        F.sha2(F.floor(F.col("o_totalprice") / 100).cast("string"), 256).alias("content_sha256"),
        F.when(low, 1).otherwise(2).alias("storage_version"))


def music_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("music_sheet_id"),
                                               F.col("p_name").alias("sheet_name"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a balance over 2,000 hold one subscription each."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 2000)
    kind = F.col("c_nationkey") % 5
    status = (F.when(kind == 0, "active").when(kind == 1, "trialing").when(kind == 2, "past_due")
              .when(kind == 3, "canceled").otherwise("expired"))
    cancel = F.col("c_custkey") % 4 == 0
    start = F.lit(JOBS_NOW) - (F.col("c_custkey") % 400) * DAY
    return (c.select(F.col("c_custkey").cast("string").alias("user_id"), status.alias("status"),
                     F.when(F.col("c_mktsegment") == "BUILDING", "yearly").otherwise("monthly").alias("plan"),
                     F.when(F.col("c_nationkey") % 2 == 0, "stripe").otherwise("apple").alias("platform"),
                     start.alias("started_at"),
                     (F.lit(JOBS_NOW) + (F.floor(F.col("c_acctbal")) - 5000) * 100).cast("bigint").alias("current_period_end"),
                     cancel.alias("cancel_at_period_end"),
                     F.when(cancel | (kind >= 3), start + 3 * DAY).alias("canceled_at"),
                     F.when(kind >= 3, start + 5 * DAY).alias("ended_at"),
                     F.concat(F.lit("sub_"), F.col("c_custkey").cast("string")).alias("subscription_id")))


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as master grants; the oldest ones carry no time."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("user_id"),
        F.when(F.col("s_nationkey") >= 5, F.lit(JOBS_NOW) - F.col("s_suppkey") * DAY).alias("granted_at"),
        F.concat(F.lit("admin"), F.col("s_nationkey").cast("string")).alias("granted_by"))


def usage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one-minute usage reports; half an hour of one person is a session."""
    return reports_of(table(spark, sf_dir, "events"))


#: A report of more seconds is refused, as the service does.
REPORT_SECONDS = 600


def reports_of(events: DataFrame) -> DataFrame:
    """The reports that the service accepts."""
    k = F.get_json_object("props", "$.k").cast("int")
    return all_reports_of(events.filter(F.floor(F.col("value")) <= REPORT_SECONDS), F.floor(F.col("value")).cast("bigint").alias("seconds"),
                          _recode(F.col("event_type"), CONTROL_OF_TYPE).alias("control"), F.floor(k / 10).cast("bigint").alias("uses"))


def all_reports_of(events: DataFrame, seconds: Column, *used: Column) -> DataFrame:
    """A report of every event, with the seconds and the use of controls that are given."""
    at = to_epoch(F.col("ts"))
    user = F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    practice = F.col("event_type").isin("click", "purchase")
    return events.select(
        user.cast("string").alias("user_id"),
        F.concat(user.cast("string"), F.lit("-"), F.floor(at / 1800).cast("string")).alias("session_id"),
        k.cast("string").alias("job_id"), F.when(practice, "practice").otherwise("sheet").alias("surface"),
        F.when(user % 2 == 1, "ios").otherwise("web").alias("platform"),
        seconds, F.floor(F.col("value") / 2).cast("bigint").alias("playing_seconds"), *used, (user % 50 == 0).alias("admin"),
        at.alias("at"), F.col("event_id").alias("seq"))


def daily_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped value per day and supplier nation as the cost of a service."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    amount = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100).cast("double") / 100
    return (li.select("l_suppkey", F.to_date("l_shipdate").alias("day"), amount.alias("amount"))
            .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy("day", F.col("n_name").alias("service"))
            .agg(F.round(F.sum("amount"), 4).alias("amount")))


#: Lines of orders that one task sorts.
TASK_LINES = 200_000


def score_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as notes: an order is a score, a line a note, four notes a bar.

    The slot is the line's place in its order; the pair (order, line number) is not unique, so all
    columns break ties and equal rows share their values anyway. An order's lines are few by its meaning, so one
    exchange by the order places them, and what follows by document finds them together. It deals them out by their number, so a
    task sorts no more lines of a larger table.
    """
    li = table(spark, sf_dir, "lineitem")
    tasks = math.ceil(li.count() / TASK_LINES)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li = li.repartition(tasks, "l_orderkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_shipdate", "l_returnflag", "l_linestatus"]
    return (row_index(li, ["l_orderkey"], order, "slot")
            .withColumn("slot", F.col("slot") - 1)
            .select(F.col("l_orderkey").alias("doc_id"), "slot",
                    F.floor(F.col("slot") / 4).cast("bigint").alias("measure"),
                    (F.col("l_suppkey") % 2 + 1).cast("bigint").alias("staff"),
                    (F.col("l_linenumber") % 2 + 1).cast("bigint").alias("voice"),
                    (F.col("l_partkey") % 88 + 21).cast("bigint").alias("midi"),
                    (F.col("l_quantity") / 4).alias("duration"),
                    F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
                    F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
                    F.col("l_linestatus").alias("line_status"), F.col("l_partkey").alias("part_key"),
                    F.col("l_suppkey").alias("supp_key"), F.col("l_linenumber").cast("bigint").alias("line_number"),
                    F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("ship_day")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two embedding components as a point on a page, in PDF points."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("label").cast("bigint").alias("page"),
        F.round(F.col("embedding")[0].cast("double") * 500 + 300, 3).alias("x"),
        F.round(F.col("embedding")[1].cast("double") * 500 + 300, 3).alias("y"),
        F.round(F.col("embedding")[2].cast("double") * 500 + 300, 3).alias("x2"),
        F.round(F.col("embedding")[3].cast("double") * 500 + 300, 3).alias("y2"),
        F.floor(F.col("embedding")[4].cast("double") * 50).cast("bigint").alias("pitch"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
