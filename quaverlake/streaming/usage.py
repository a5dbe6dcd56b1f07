"""Usage streams: sessions, the activity meter, debounce, report cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.operators.engagement import MAX_REPORT_SECONDS, sessions
from quaverlake.operators.segments import carry_last, islands, previous, settle, with_totals

# Fixed values, in milliseconds.
IDLE_MS, MAX_TICK_MS, REPEAT_MS = 300_000, 5_000, 2_000


def usage_sessions(reports: DataFrame) -> DataFrame:
    """ST-01: one running row per session, as a streaming aggregate in update mode: first values kept,
    seconds and uses added, the latest time, and when the row expires.

    ``reports`` carries wide counters. It is the batch operator (A-04) on a stream, so both give the same
    rows; the state is one small row per session, kept on the JVM side.
    """
    return sessions(reports)


def live_sessions(table: DataFrame, now: int) -> DataFrame:
    """ST-01: the sessions that have not expired, ``KEEP_DAYS`` after their start."""
    return table.filter(F.col("expires_at") > now)


# --- the activity meter --------------------------------------------------------------------------

def activity(events: DataFrame, keys: Sequence[str] = ("session_id",), chunk_ms: int | None = None) -> DataFrame:
    """ST-02: active and playing milliseconds each tick adds.

    ``events``: at_ms, seq, kind (tick, input, count), visible, playing. A tick counts at most five seconds;
    without input for five minutes nothing, unless something plays; hidden time never. Opening the page, the
    session's first event, is input.
    """
    order = ["at_ms", "seq"]
    chunk = None if chunk_ms is None else F.floor(F.col("at_ms") / chunk_ms).cast("bigint")
    e = with_totals(events, keys, __open=F.min("at_ms"))
    e = carry_last(e, keys, order, F.when(F.col("kind") == "tick", F.col("at_ms")), "__tick", chunk, inclusive=False)
    e = carry_last(e, keys, order, F.when(F.col("kind").isin("input", "count"), F.col("at_ms")), "__input", chunk)
    ticks = e.filter(F.col("kind") == "tick")
    elapsed = F.least(F.lit(MAX_TICK_MS), F.greatest(F.lit(0), F.col("at_ms") - F.coalesce("__tick", "__open")))
    awake = F.least(elapsed, F.greatest(F.lit(0), F.coalesce("__input", "__open") + IDLE_MS - (F.col("at_ms") - elapsed)))
    return (ticks.withColumn("active_ms", F.when(~F.col("visible"), 0).when(F.col("playing"), elapsed).otherwise(awake).cast("bigint"))
            .withColumn("playing_ms", F.when(F.col("visible") & F.col("playing"), elapsed).otherwise(0).cast("bigint"))
            .drop("__tick", "__input", "__open"))


def debounce(events: DataFrame, gap_ms: int = REPEAT_MS, keys: Sequence[str] = ("session_id", "control"),
             chunk_ms: int | None = None) -> DataFrame:
    """ST-03: the uses that count: the first, then each at least ``gap_ms`` after the last *counted* one.

    A use that far from the use before it always counts, so those uses cut the sequence into bursts that
    do not depend on each other. Only inside a burst, a drag of a few seconds, a fold walks the uses in order.
    """
    order = ["at_ms", "seq"]
    chunk = None if chunk_ms is None else F.floor(F.col("at_ms") / chunk_ms).cast("bigint")
    e = previous(events, keys, order, {"__prev": "at_ms"}, chunk)
    fresh = F.col("__prev").isNull() | (F.col("at_ms") - F.col("__prev") >= gap_ms)
    e = settle(islands(e, keys, order, fresh, "__burst", chunk), chunk)
    # Uses at one instant count once, so a burst holds one entry per millisecond at most.
    times = e.groupBy(*keys, "__burst", "at_ms").agg(F.min("seq").alias("seq"))
    kind = "struct<last: bigint, kept: array<struct<at_ms: bigint, seq: bigint>>>"

    def step(acc: Column, x: Column) -> Column:
        counts = acc["last"].isNull() | (x["at_ms"] - acc["last"] >= gap_ms)
        return F.struct(F.when(counts, x["at_ms"]).otherwise(acc["last"]).alias("last"),
                        F.when(counts, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept")).cast(kind)

    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().alias("kept")).cast(kind)
    uses = times.groupBy(*keys, "__burst").agg(F.array_sort(F.collect_list(F.struct(
        F.col("at_ms").cast("bigint").alias("at_ms"), F.col("seq").cast("bigint").alias("seq")))).alias("__u"))
    kept = uses.select(*keys, F.explode(F.aggregate("__u", start, step)["kept"]).alias("k"))
    return kept.select(*keys, "k.at_ms", "k.seq")


def cut_reports(cuts: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "cut") -> DataFrame:
    """ST-04: what each report of a session carries: whole seconds, 600 at most, the rest kept for the next;
    a report that failed (``sent`` false) goes back, again up to 600.

    ``cuts``: one row per report with active_ms and playing_ms gathered since the one before. A session
    reports once a minute, so its sequence is short and is folded in order.
    """
    most = MAX_REPORT_SECONDS
    rows = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).cast("bigint").alias("cut"), F.col("active_ms").cast("bigint").alias("a"), F.col("playing_ms").cast("bigint").alias("p"),
        F.coalesce("sent", F.lit(True)).alias("sent")))).alias("__c"))
    kind = "struct<a: bigint, p: bigint, out: array<struct<cut: bigint, seconds: bigint, playing_seconds: bigint, sent: boolean>>>"

    def step(acc: Column, x: Column) -> Column:
        a, p = acc["a"] + x["a"], acc["p"] + x["p"]
        secs = F.least(F.lit(most), F.floor(a / 1000))
        play = F.least(secs, F.floor(p / 1000))
        left_a, left_p = F.greatest(F.lit(0), a - secs * 1000), F.greatest(F.lit(0), p - play * 1000)
        back_a = F.least(F.lit(most * 1000), left_a + secs * 1000)
        row = F.struct(x["cut"].alias("cut"), secs.alias("seconds"), play.alias("playing_seconds"), x["sent"].alias("sent"))
        return F.struct(F.when(x["sent"], left_a).otherwise(back_a).alias("a"),
                        F.when(x["sent"], left_p).otherwise(F.least(back_a, left_p + play * 1000)).alias("p"),
                        F.concat(acc["out"], F.array(row)).alias("out")).cast(kind)

    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("p"), F.array().alias("out")).cast(kind)
    return rows.select(*keys, F.explode(F.aggregate("__c", start, step)["out"]).alias("r")).select(*keys, "r.*")
