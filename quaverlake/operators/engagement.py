"""Usage reports, sessions and engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.times import DAY, day_date, day_span, day_spine, local_day

# Pages, apps and the controls whose use is counted, in report order.
SURFACES = ("sheet", "practice")
PLATFORMS = ("web", "ios")
CONTROLS = ("play", "measure", "step", "scrub", "speed", "tempo", "balance", "instrument", "sound", "paywall",
            "notation", "view", "download", "edit")
KEEP_DAYS = 400
MAX_REPORT_SECONDS = 600
MAX_USES = 1000
SESSION_ID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# Allowed reader settings.
SETTING_CHOICES = {"sheet_view": ("annotated", "original"), "notation": ("letters", "numbers", "solfege"),
                   "page_mode": ("scroll", "swipe")}
SETTING_FLAGS = ("show_key_names", "show_note_names", "sound_on", "sheet_open", "roll_open")
SETTING_RANGES = {"speed": (0.1, 2.0), "split": (0.0, 1.0)}
INSTRUMENT_ID = r"^[a-z0-9-]{1,32}$"


def report_errors(session_pattern: str | None = SESSION_ID) -> Column:
    """P-01: what is wrong with a usage report, as an array of field names (empty when valid)."""
    def bad(cond: Column, name: str) -> Column:
        return F.when(~F.coalesce(cond, F.lit(False)), F.lit(name))

    def seconds(col: str) -> Column:
        return F.coalesce(F.col(col), F.lit(0)).between(0, MAX_REPORT_SECONDS)

    events = F.coalesce(F.col("events"), F.create_map().cast("map<string,int>"))
    checks = [
        bad(F.col("session_id").rlike(session_pattern), "session_id") if session_pattern else F.lit(None).cast("string"),
        bad(F.length("job_id").between(1, 100), "job_id"),
        bad(F.col("surface").isin(*SURFACES), "surface"),
        bad(F.coalesce(F.col("platform"), F.lit("web")).isin(*PLATFORMS), "platform"),
        bad(seconds("seconds"), "seconds"), bad(seconds("playing_seconds"), "playing_seconds"),
        bad(F.forall(F.map_entries(events), lambda e: e["key"].isin(*CONTROLS) & e["value"].between(0, MAX_USES)),
            "events")]
    return F.array_compact(F.array(*checks))


def validate_reports(df: DataFrame, session_pattern: str | None = SESSION_ID) -> tuple[DataFrame, DataFrame]:
    """P-01: (accepted, rejected); a rejected report keeps its reasons. Unknown keys of the raw
    record arrive in ``extra`` (an array) where the reader gives one."""
    errors = report_errors(session_pattern)
    if "extra" in df.columns:
        errors = F.concat(errors, F.coalesce(F.col("extra"), F.array().cast("array<string>")))
    marked = df.withColumn("reasons", errors)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def validate_settings(df: DataFrame, json: str = "settings") -> DataFrame:
    """P-14: adds ``reasons`` to rows of settings JSON; absent settings are unchanged, unknown ones refused."""
    allowed = [*SETTING_CHOICES, "instrument", *SETTING_RANGES, *SETTING_FLAGS]
    raw = F.from_json(F.col(json), "map<string,string>")
    kinds = {**{k: "string" for k in (*SETTING_CHOICES, "instrument")}, **{k: "double" for k in SETTING_RANGES},
             **{k: "boolean" for k in SETTING_FLAGS}}
    typed = F.from_json(F.col(json), ", ".join(f"{k} {t}" for k, t in kinds.items()))
    d = df.withColumn("__raw", raw).withColumn("__t", typed)

    def bad(name: str, ok: Column) -> Column:
        given = F.coalesce(F.col("__raw")[name], F.lit("null")) != "null"
        return F.when(given & ~F.coalesce(ok, F.lit(False)), F.lit(name))

    checks = [bad(k, F.col(f"__t.{k}").isin(*v)) for k, v in SETTING_CHOICES.items()]
    checks.append(bad("instrument", F.col("__t.instrument").rlike(INSTRUMENT_ID)))
    checks += [bad(k, F.col(f"__t.{k}").between(*v)) for k, v in SETTING_RANGES.items()]
    checks += [bad(k, F.col(f"__t.{k}").isNotNull()) for k in SETTING_FLAGS]
    unknown = F.array_except(F.map_keys("__raw"), F.array(*[F.lit(a) for a in allowed]))
    whole = F.array_compact(F.array(F.when(F.col("__raw").isNull(), F.lit("not an object"))))
    return (d.withColumn("reasons", F.concat(whole, F.array_compact(F.array(*checks)),
                                             F.coalesce(unknown, F.array().cast("array<string>"))))
            .drop("__raw", "__t"))


def control_counts(reports: DataFrame) -> DataFrame:
    """Reports with an events map as wide ``e_<control>`` counters."""
    return reports.select("*", *[F.coalesce(F.col("events")[c], F.lit(0)).alias(f"e_{c}") for c in CONTROLS])


def single_control(reports: DataFrame) -> DataFrame:
    """Reports of one control each (``control``, ``uses``) as wide ``e_<control>`` counters."""
    return reports.select("*", *[F.when(F.col("control") == c, F.col("uses")).otherwise(0).alias(f"e_{c}")
                                 for c in CONTROLS])


def sessions(reports: DataFrame) -> DataFrame:
    """A-04: one row per (person, session): first values kept, seconds and uses added up.

    ``reports`` carries wide counters (:func:`control_counts`). Every aggregate is combined before
    the shuffle.
    """
    first = F.struct("at", "seq")
    return reports.groupBy("user_id", "session_id").agg(
        *[F.min_by(c, first).alias(c) for c in ("job_id", "surface", "platform")],
        F.min("at").alias("started_at"), F.max("at").alias("last_at"),
        (F.min("at") + KEEP_DAYS * DAY).alias("expires_at"), F.sum("seconds").alias("seconds"),
        F.sum("playing_seconds").alias("playing_seconds"), F.count(F.lit(1)).alias("reports"),
        F.bool_or(F.coalesce(F.col("admin"), F.lit(False))).alias("admin"),
        *[F.sum(f"e_{c}").alias(f"e_{c}") for c in CONTROLS])


def session_view(df: DataFrame) -> DataFrame:
    """P-02: the wide counters as a map of those that are not zero, missing numbers as 0."""
    pairs = [x for c in CONTROLS for x in (F.lit(c), F.coalesce(F.col(f"e_{c}"), F.lit(0)).cast("bigint"))]
    nums = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("started_at", "last_at", "seconds", "playing_seconds")}
    return (df.withColumns(nums).withColumn("admin", F.coalesce(F.col("admin"), F.lit(False)))
            .withColumn("events", F.map_filter(F.create_map(*pairs), lambda k, v: v > 0))
            .drop(*[f"e_{c}" for c in CONTROLS]))


def real_sessions(df: DataFrame) -> DataFrame:
    """P-12: sessions of readers in which anything happened."""
    return df.filter(~F.col("admin") & ((F.col("seconds") != 0) | (F.size("events") > 0)))


def in_span(sessions: DataFrame, now: int, days: int, offset: int) -> DataFrame:
    """Sessions of the last ``days`` local days, with their ``day``. A session counts on the day it started."""
    first, _ = day_span(now, days, offset, KEEP_DAYS)
    day = local_day(F.col("started_at"), offset)
    return sessions.withColumn("day", day).filter(F.col("day") >= first)


def engagement_totals(sessions: DataFrame, accounts: DataFrame) -> DataFrame:
    """A-05: people, with and without accounts, sessions and seconds per page.

    People are reduced to one row each first, so the account join sees people, not sessions.
    """
    def on(s: str) -> Column:
        return F.col("surface") == s

    people = sessions.groupBy("user_id").agg(
        F.max(on("practice").cast("int")).alias("practising"),
        *[F.count_if(on(s)).alias(f"n_{s}") for s in SURFACES],
        *[F.coalesce(F.sum(F.when(on(s), F.col("seconds"))), F.lit(0)).alias(f"s_{s}") for s in SURFACES],
        F.sum("playing_seconds").alias("playing"))
    ids = accounts.select("user_id").distinct().withColumn("__a", F.lit(1))
    return people.join(ids, "user_id", "left").agg(
        F.count(F.lit(1)).alias("users"), F.count("__a").alias("accounts"),
        F.count_if(F.col("__a").isNull()).alias("guests"),
        F.count_if(F.col("practising") == 1).alias("practicing_users"),
        *[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"{s}_sessions") for s in SURFACES],
        *[F.coalesce(F.sum(f"s_{s}"), F.lit(0)).alias(f"{s}_seconds") for s in SURFACES],
        F.coalesce(F.sum("playing"), F.lit(0)).alias("playing_seconds"))


def engagement_days(sessions: DataFrame, now: int, days: int = 30, offset: int = 0) -> DataFrame:
    """A-06: seconds and people per local day, every day present.

    Grouped by (day, person) first and by day second: a day's people are counted without keeping a
    set of them.
    """
    def surface_sum(s: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("surface") == s, F.col("seconds"))), F.lit(0)).alias(f"{s}_seconds")

    names = ("sheet_seconds", "practice_seconds", "playing_seconds")
    per_day = (in_span(sessions, now, days, offset).groupBy("day", "user_id")
               .agg(*[surface_sum(s) for s in SURFACES], F.sum("playing_seconds").alias("playing_seconds"))
               .groupBy("day").agg(*[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("users")))
    spine = day_spine(sessions.sparkSession, now, days, offset, KEEP_DAYS)
    return (spine.join(per_day, "day", "left").orderBy("day")
            .select(day_date(F.col("day")).alias("date"),
                    *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in (*names, "users")]))


def median_day_seconds(sessions: DataFrame, now: int, days: int = 30, offset: int = 0) -> DataFrame:
    """A-07: the median of seconds per person and day. The aggregate keeps one counter per distinct
    number of seconds, which a day bounds."""
    return (in_span(sessions, now, days, offset).groupBy("user_id", "day")
            .agg(F.sum("seconds").alias("s")).agg(F.median("s").alias("median_day_seconds")))


def controls(sessions: DataFrame) -> DataFrame:
    """A-08: people, uses and sessions per page for every control, unused ones kept."""
    spark = sessions.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(CONTROLS)], "event string, position int")
    used = sessions.select("user_id", "surface", F.explode("events").alias("event", "n"))
    # Per person first, so that no set of people is kept per control.
    per_person = used.groupBy("event", "user_id").agg(
        F.sum("n").alias("uses"), *[F.count_if(F.col("surface") == s).alias(s) for s in SURFACES])
    totals = per_person.groupBy("event").agg(F.count(F.lit(1)).alias("users"), F.sum("uses").alias("uses"),
                                             *[F.sum(s).alias(s) for s in SURFACES])
    return (names.join(totals, "event", "left")
            .select("event", "position", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                           for c in ("users", "uses", *SURFACES)])
            .orderBy("position"))


def control_order(controls_df: DataFrame) -> DataFrame:
    """T-05: most people first, then most uses."""
    return controls_df.orderBy(F.col("users").desc(), F.col("uses").desc(), F.col("position"))


def top_sheets(sessions: DataFrame, k: int = 10) -> DataFrame:
    """A-09: the sheets that held readers longest. The cut comes before any name join."""
    per = (sessions.groupBy("job_id", "user_id")
           .agg(*[F.coalesce(F.sum(F.when(F.col("surface") == s, F.col("seconds"))), F.lit(0)).alias(f"{s}_seconds")
                  for s in SURFACES], F.sum("playing_seconds").alias("playing_seconds"))
           .groupBy("job_id").agg(F.count(F.lit(1)).alias("users"),
                                  *[F.sum(f"{s}_seconds").alias(f"{s}_seconds") for s in SURFACES],
                                  F.sum("playing_seconds").alias("playing_seconds")))
    return per.orderBy((F.col("sheet_seconds") + F.col("practice_seconds")).desc(), F.col("job_id")).limit(k)


def latest_sessions(sessions: DataFrame, n: int = 50) -> DataFrame:
    """W-02: the newest ``n`` sessions of each person."""
    from quaverlake.operators.ranks import top_n_per_key
    return top_n_per_key(sessions, ["user_id"], [F.col("started_at").desc(), F.col("session_id")], n)
