"""The bindings of ``sources.bindings`` once more as SQL, for the independent check."""

from __future__ import annotations

from quaverlake.sources.bindings import EVENTS_NOW, JOBS_NOW

_CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "accounts": ((), """
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS email,
               CAST(epoch_us(f) // 1000000 AS BIGINT) AS created_at,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'web' WHEN 'MACHINERY' THEN 'ios'
                    WHEN 'AUTOMOBILE' THEN 'desktop' END AS signup_platform
        FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1)
             ON o_custkey = c_custkey
        WHERE c_custkey % 3 <> 0"""),
    "job_heads": ((), """
        SELECT o_orderkey AS job_key, CAST(o_orderkey AS VARCHAR) AS job_id, CAST(o_custkey AS VARCHAR) AS user_id,
               CAST(o_orderkey % 2500 AS VARCHAR) AS music_sheet_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'Urgent ' || o_orderkey END AS sheet_name,
               CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'failed'
                    WHEN o_orderpriority = '5-LOW' THEN 'deleted' WHEN o_orderpriority = '3-MEDIUM' THEN 'processing'
                    ELSE 'queued' END AS status,
               CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS created_at,
               CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS queued_at,
               CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(epoch_us(o_orderdate) // 1000000 + 7200 AS BIGINT) END AS republished_at,
               CAST(floor(o_totalprice * 40) AS BIGINT) AS size,
               sha256(CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS VARCHAR)) AS content_sha256,
               CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 2 END AS storage_version
        FROM orders"""),
    "jobs": (("job_heads",), """
        SELECT h.*, fin AS finished_at, coalesce(fin, created_at + 3600) AS updated_at,
               coalesce(returned, false) AS review, coalesce(n_lines, 0) AS attempt_count
        FROM job_heads h LEFT JOIN (
            SELECT l_orderkey, CAST(epoch_us(max(l_shipdate)) // 1000000 AS BIGINT) AS fin,
                   bool_or(l_returnflag = 'R') AS returned, count(*) AS n_lines
            FROM lineitem GROUP BY 1) ON l_orderkey = job_key"""),
    "live_jobs": (("jobs",), """
        SELECT *, CASE WHEN status = 'done' THEN
                 coalesce(finished_at, CASE WHEN republished_at IS NULL THEN updated_at END) - queued_at END AS seconds,
               CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'done' AND review THEN 'warning'
                    WHEN status = 'done' THEN 'done' END AS outcome
        FROM jobs"""),
    "sheets": ((), "SELECT CAST(p_partkey AS VARCHAR) AS music_sheet_id, p_name AS sheet_name FROM part"),
    "subs": ((), f"""
        SELECT CAST(c_custkey AS VARCHAR) AS user_id,
               CASE c_nationkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due'
                    WHEN 3 THEN 'canceled' ELSE 'expired' END AS status,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'yearly' ELSE 'monthly' END AS plan,
               CASE WHEN c_nationkey % 2 = 0 THEN 'stripe' ELSE 'apple' END AS platform,
               CAST({JOBS_NOW} - (c_custkey % 400) * 86400 AS BIGINT) AS started_at,
               CAST({JOBS_NOW} + (floor(c_acctbal) - 5000) * 100 AS BIGINT) AS current_period_end,
               c_custkey % 4 = 0 AS cancel_at_period_end,
               CASE WHEN c_custkey % 4 = 0 OR c_nationkey % 5 >= 3
                    THEN CAST({JOBS_NOW} - (c_custkey % 400) * 86400 + 259200 AS BIGINT) END AS canceled_at,
               CASE WHEN c_nationkey % 5 >= 3
                    THEN CAST({JOBS_NOW} - (c_custkey % 400) * 86400 + 432000 AS BIGINT) END AS ended_at,
               'sub_' || c_custkey AS subscription_id
        FROM customer WHERE c_acctbal > 2000"""),
    "sub_views": (("subs",), f"""
        SELECT *, status IN ('active', 'trialing') AND NOT ((cancel_at_period_end OR platform = 'apple')
                  AND current_period_end <= {JOBS_NOW}) AS premium
        FROM subs"""),
    "sub_states": (("sub_views",), """
        SELECT *, CASE WHEN premium AND cancel_at_period_end THEN 'canceling'
                       WHEN premium AND status = 'trialing' THEN 'trial' WHEN premium THEN 'active'
                       WHEN status = 'past_due' THEN 'past_due' ELSE 'canceled' END AS state
        FROM sub_views"""),
    "masters": ((), f"""
        SELECT CAST(s_suppkey AS VARCHAR) AS user_id,
               CASE WHEN s_nationkey >= 5 THEN CAST({JOBS_NOW} - s_suppkey * 86400 AS BIGINT) END AS granted_at,
               'admin' || s_nationkey AS granted_by
        FROM supplier"""),
    "reports": ((), """
        SELECT CAST(user_id AS VARCHAR) AS user_id, user_id || '-' || (tick // 1800) AS session_id,
               CAST(k AS VARCHAR) AS job_id,
               CASE WHEN event_type IN ('click', 'purchase') THEN 'practice' ELSE 'sheet' END AS surface,
               CASE WHEN user_id % 2 = 1 THEN 'ios' ELSE 'web' END AS platform,
               CAST(floor(value) AS BIGINT) AS seconds,
               CAST(floor(value / 2) AS BIGINT) AS playing_seconds,
               CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'play' WHEN 'purchase' THEN 'paywall'
                    WHEN 'signup' THEN 'speed' ELSE 'edit' END AS control,
               CAST(k // 10 AS BIGINT) AS uses, user_id % 50 = 0 AS admin, tick, event_id AS seq
        FROM (SELECT *, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS tick,
                     CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE floor(value) <= 600)"""),
    "sessions": (("reports",), """
        SELECT user_id, session_id, first(job_id ORDER BY tick, seq) AS job_id,
               first(surface ORDER BY tick, seq) AS surface, first(platform ORDER BY tick, seq) AS platform,
               min(tick) AS started_at, max(tick) AS last_at, CAST(sum(seconds) AS BIGINT) AS seconds,
               CAST(sum(playing_seconds) AS BIGINT) AS playing_seconds, count(*) AS reports,
               bool_or(admin) AS admin, CAST(sum(uses) AS BIGINT) AS uses
        FROM reports GROUP BY ALL"""),
    "real_sessions": (("sessions",), "SELECT * FROM sessions WHERE NOT admin AND (seconds <> 0 OR uses > 0)"),
    "uses": (("reports", "real_sessions"), """
        SELECT s.user_id, s.session_id, s.surface, r.control, CAST(sum(r.uses) AS BIGINT) AS uses
        FROM real_sessions s JOIN reports r USING (user_id, session_id)
        GROUP BY ALL HAVING sum(r.uses) > 0"""),
    "costs": ((), """
        SELECT CAST(l_shipdate AS DATE) AS day, n_name AS service,
               round(sum(floor(l_extendedprice * (1 - l_discount) / 100) / 100), 4) AS amount
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2"""),
    "notes": ((), """
        SELECT l_orderkey AS doc_id, slot, slot // 4 AS measure, l_suppkey % 2 + 1 AS staff,
               CAST(l_linenumber % 2 + 1 AS BIGINT) AS voice, l_partkey % 88 + 21 AS midi, l_quantity / 4 AS duration,
               l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag,
               l_linestatus AS line_status, l_partkey AS part_key, l_suppkey AS supp_key,
               CAST(l_linenumber AS BIGINT) AS line_number,
               datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS ship_day
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                     l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS slot
              FROM lineitem)"""),
    "points": ((), """
        SELECT vec_id AS point_id, CAST(label AS BIGINT) AS page,
               round(CAST(embedding[1] AS DOUBLE) * 500 + 300, 3) AS x,
               round(CAST(embedding[2] AS DOUBLE) * 500 + 300, 3) AS y,
               round(CAST(embedding[3] AS DOUBLE) * 500 + 300, 3) AS x2,
               round(CAST(embedding[4] AS DOUBLE) * 500 + 300, 3) AS y2,
               CAST(floor(CAST(embedding[5] AS DOUBLE) * 50) AS BIGINT) AS pitch
        FROM embeddings"""),
}


def define(name: str, sql: str, *needs: str) -> None:
    """Add a shared CTE."""
    _CTE[name] = (needs, sql)


def with_ctes(*names: str) -> str:
    """A WITH clause holding the named CTEs and what they need, in order."""
    seen: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in seen:
            return
        needs, sql = _CTE[name]
        for need in needs:
            visit(need)
        seen[name] = sql

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in seen.items()) + "\n"


__all__ = ["define", "with_ctes", "EVENTS_NOW", "JOBS_NOW"]
