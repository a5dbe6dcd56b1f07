"""The service's entry points as compositions of operators. Each takes tables, parameters and ``now``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.operators import accounts as A
from quaverlake.operators import costs as C
from quaverlake.operators import engagement as E
from quaverlake.operators import quality as Q
from quaverlake.operators import ranks as R
from quaverlake.operators import subscriptions as S
from quaverlake.operators import uploads as U

PAGE_SIZE, MAX_SIZE = 50, 200


def _newest(col: str, tie: str):
    return [(F.coalesce(F.col(col), F.lit(0)), False), (F.col(tie), True)]


def overview(accounts: DataFrame, subscriptions: DataFrame, jobs: DataFrame, now: int, demo_owner: str) -> DataFrame:
    return U.overview(accounts, subscriptions, U.real_uploads(jobs, demo_owner), now)


def users(accounts, subscriptions, masters, jobs, sessions, now: int, demo_owner: str, page: int = 1, page_size: int = PAGE_SIZE,
          **facets) -> DataFrame:
    rollup = A.users_rollup(accounts, subscriptions, masters, U.real_uploads(jobs, demo_owner), E.session_view(sessions), now)
    return R.paginate(A.users(rollup, now, **facets), _newest("created_at", "user_id"), page, page_size, MAX_SIZE)


def signups(accounts: DataFrame, now: int, longest: int, days: int = 30, offset: int = 0) -> dict[str, DataFrame]:
    rows = A.signups(accounts, now, days, offset, longest)
    return {"days": rows, "totals": A.signup_totals(rows)}


def engagement(sessions: DataFrame, accounts: DataFrame, jobs: DataFrame, sheets: DataFrame, now: int, days: int = 30, offset: int = 0,
               demo_job: str | None = None, demo_name: str | None = None) -> dict[str, DataFrame]:
    """Five results over one set of sessions; names are fetched for the ten listed sheets only."""
    real = E.in_span(E.real_sessions(E.session_view(sessions)), now, days, offset)
    top = E.top_sheets(real)
    listed = jobs.join(F.broadcast(top.select("job_id")), "job_id", "left_semi")  # ten ids
    names = U.with_sheet_name(listed, sheets, demo_job, demo_name).select("job_id", "sheet_name")
    return {"totals": E.engagement_totals(real, accounts), "median": E.median_day_seconds(real, now, days, offset),
            "days": E.engagement_days(real, now, days, offset), "controls": E.controls(real), "sheets": top.join(names, "job_id", "left")}


def masters(grants: DataFrame, accounts: DataFrame) -> DataFrame:
    return R.newest_first(A.masters_listing(grants, accounts), "granted_at", "user_id")


def subscriptions(table: DataFrame, now: int, state: str = "", page: int = 1, page_size: int = PAGE_SIZE) -> dict[str, DataFrame]:
    rows = S.subscription_state(S.subscription_view(table, now))
    listed = rows.filter(F.col("state") == state) if state else rows
    return {"items": R.paginate(listed, _newest("started_at", "user_id"), page, page_size, MAX_SIZE), "counts": S.subscription_counts(rows)}


def uploads(jobs: DataFrame, sheets: DataFrame, accounts: DataFrame, now: int, demo_owner: str, status: str = "", page: int = 1,
            page_size: int = PAGE_SIZE, **facets) -> dict[str, DataFrame]:
    view = U.with_guest(U.with_sheet_name(U.job_outcome(U.job_seconds(U.with_copies(jobs))), sheets), accounts)
    narrowed = U.filter_uploads(U.real_uploads(view, demo_owner), now, **facets)
    return {"items": R.paginate(U.filter_status(narrowed, status), _newest("created_at", "job_id"), page, page_size, MAX_SIZE),
            "summary": U.outcome_summary(narrowed)}


def user_uploads(jobs: DataFrame, sheets: DataFrame, user_id: str) -> DataFrame:
    mine = U.with_copies(jobs).filter(F.col("user_id") == user_id)
    return R.newest_first(U.with_sheet_name(U.job_seconds(mine), sheets), "created_at", "job_id")


def user_usage(sessions: DataFrame, jobs: DataFrame, sheets: DataFrame, user_id: str, limit: int = 50) -> DataFrame:
    mine = E.latest_sessions(E.session_view(sessions.filter(F.col("user_id") == user_id)), max(1, min(limit, 500)))
    names = U.with_sheet_name(jobs.select("job_id", "music_sheet_id", "sheet_name"), sheets).select("job_id", "sheet_name")
    return R.newest_first(mine.join(names, "job_id", "left"), "started_at", "session_id")


def system(jobs: DataFrame, demo_owner: str) -> DataFrame:
    return U.active_jobs(U.reprocess_view(U.real_uploads(jobs, demo_owner)))


def library(jobs: DataFrame, sheets: DataFrame, user_id: str) -> DataFrame:
    mine = jobs.filter((F.col("user_id") == user_id) & ~F.col("status").isin(*U.REMOVED))
    return R.newest_first(U.readiness(U.with_sheet_name(mine, sheets)), "created_at", "job_id")


def workload(jobs: DataFrame, costs: DataFrame, now: int, days: int, first_day: str, end_day: str) -> dict[str, DataFrame]:
    recent = jobs.filter(F.col("created_at") >= now - days * 86400)
    done = recent.filter(F.col("status") == "done").withColumn("duration", F.col("updated_at") - F.col("created_at"))
    daily = C.daily_cost(costs)
    return {"summary": U.workload(recent, days), "statuses": U.workload_statuses(recent),
            "durations": R.percentile_ranks(done, "duration", {"p50": 0.5, "p95": 0.95, "max": 1.0}),
            "daily_cost": daily, "settled": C.settled_average(daily), "monthly_cost": C.monthly_cost(costs, first_day, end_day)}


def recognition_audit(heads, exported, playable, printed, measures, keys=("doc_id", "page")) -> dict[str, DataFrame]:
    pages = Q.funnel(heads, exported, playable, printed, list(keys))
    return {"pages": pages, "totals": Q.funnel_totals(pages, [keys[0]]), "off_modal": Q.off_modal(measures, [keys[0]])}


def quality_report(parsed_timelines: DataFrame) -> dict[str, DataFrame]:
    """From :func:`sources.documents.parse_timelines`: quality per document and its most frequent warnings."""
    from quaverlake.sources.documents import quality_input, timeline_table
    bars = timeline_table(parsed_timelines, "measures").select("doc_id", "pos", F.posexplode("warnings").alias("i", "warning"))
    warnings = bars.select("doc_id", (F.col("pos").cast("bigint") * 1_000_000 + F.col("i")).alias("position"), "warning")
    return {"quality": Q.timeline_quality(quality_input(parsed_timelines)), "top_warnings": Q.top_warnings(warnings)}
