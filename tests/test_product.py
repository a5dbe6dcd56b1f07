"""Product analytics on small tables with known answers."""

import random

from pyspark.sql import functions as F

from quaverlake.operators import accounts as A
from quaverlake.operators import engagement as E
from quaverlake.operators import quality as Q
from quaverlake.operators import uploads as U
from quaverlake.operators.ranks import paginate, rank_slice
from quaverlake.streaming import usage as US

NOW = 1_700_000_000
DAY = 86400


def sessions(spark):
    rows = [("a", "s1", "j1", "sheet", NOW - 50, NOW - 30, 120, 0, {"play": 2}, False), ("a", "s2", "j1", "practice", NOW - 40, NOW - 30, 600, 500, {"play": 4}, False),
            ("g", "s3", "j2", "practice", NOW - 60, NOW - 20, 90, 60, {}, False), ("x", "s4", "j2", "practice", NOW - 60, NOW - 20, 900, 0, {}, True),
            ("e", "s5", "j2", "sheet", NOW - 60, NOW - 20, 0, 0, {}, False), ("a", "s6", "j3", "practice", NOW - 2 * DAY, NOW - 2 * DAY, 300, 0, {}, False)]
    return spark.createDataFrame(rows, "user_id string, session_id string, job_id string, surface string, started_at long, last_at long, seconds long, "
                                       "playing_seconds long, events map<string,long>, admin boolean")


def test_engagement(spark):
    real = E.in_span(E.real_sessions(sessions(spark)), NOW, 30, 0)
    accounts = spark.createDataFrame([("a",), ("z",)], "user_id string")
    t = E.engagement_totals(real, accounts).first()
    assert (t.users, t.accounts, t.guests, t.practicing_users) == (2, 1, 1, 2)
    assert (t.sheet_sessions, t.practice_sessions, t.sheet_seconds, t.practice_seconds, t.playing_seconds) == (1, 3, 120, 990, 560)
    assert E.median_day_seconds(real, NOW).first()[0] == 300
    days = E.engagement_days(real, NOW).collect()
    assert len(days) == 30 and tuple(days[-1])[1:] == (120, 690, 560, 2)
    c = {r.event: r for r in E.controls(real).collect()}
    assert len(c) == 14 and (c["play"].users, c["play"].uses, c["play"].sheet, c["play"].practice) == (1, 6, 1, 1) and c["edit"].uses == 0
    assert [r.job_id for r in E.top_sheets(real).collect()] == ["j1", "j3", "j2"]


def test_report_validation(spark):
    good = ("0123abcd-0123-0123-0123-0123456789ab", "j", "sheet", None, 60, 0, {"play": 3}, [])
    rows = [good, ("no", *good[1:]), (good[0], "", *good[2:]), (*good[:2], "lobby", *good[3:]), (*good[:3], "mac", *good[4:]), (*good[:4], 601, *good[5:]),
            (*good[:6], {"fly": 1}, []), (*good[:6], {"play": 1001}, []), (*good[:7], ["volume"])]
    df = spark.createDataFrame(rows, "session_id string, job_id string, surface string, platform string, seconds int, playing_seconds int, events map<string,int>, extra array<string>")
    ok, bad = E.validate_reports(df)
    assert ok.count() == 1 and bad.count() == 8
    assert {r.reasons[0] for r in bad.collect()} == {"session_id", "job_id", "surface", "platform", "seconds", "events", "volume"}


def test_paging_clamps(spark):
    df = spark.range(5)
    page = paginate(df, [(F.col("id"), False)], 9, 2, 200).collect()
    assert [(r.id, r.page, r.pages, r.total) for r in page] == [(0, 3, 3, 5)]


def test_deep_pages_are_found_by_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *"abcdefgh"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, i int").repartition(4).cache()
    for ups in ((True, False, True), (False, True, False), (True, True, True)):
        order = [(F.col(c), up) for c, up in zip("abi", ups)]
        want = [r.i for r in df.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in zip("abi", ups)]).collect()]
        for first, last in ((0, 50), (1480, 1500), (2990, 3000), (7, 2000)):
            got = rank_slice(df, order, first, last, 3000, splits=5, enough=60)
            assert [r.i for r in got.collect()] == want[first:last]
    # Rows that are all alike can't be cut.
    alike = spark.createDataFrame([(1, "x")] * 500, "a int, b string")
    assert rank_slice(alike, [(F.col("a"), True), (F.col("b"), False)], 480, 490, 500, splits=4, enough=10).count() == 10


def test_job_outcomes(spark):
    rows = [("1", "done", 100, 160, 170, None, ["odd"]), ("2", "done", 100, None, 190, None, []), ("3", "done", 100, None, 190, 185, None), ("4", "failed", 100, 130, 130, None, None)]
    df = spark.createDataFrame(rows, "job_id string, status string, queued_at long, finished_at long, updated_at long, republished_at long, review_reasons array<string>")
    got = {r.job_id: (r.seconds, r.outcome) for r in U.job_outcome(U.job_seconds(df)).collect()}
    assert got == {"1": (60, "warning"), "2": (90, "done"), "3": (None, "done"), "4": (None, "failed")}


def test_signups_move_with_the_calendar(spark):
    acc = spark.createDataFrame([("a", NOW - 3 * DAY, "web"), ("b", NOW, "fax"), ("c", None, "ios")], "user_id string, created_at long, signup_platform string")
    days = A.signups(acc, NOW, 60, 0, 3660).collect()
    assert len(days) == 60 and sum(d["count"] for d in days) == 2 and days[-1].unknown == 1 and days[-4].web == 1
    assert A.signups(acc, NOW, 60, 840, 3660).collect()[-1].date > days[-1].date


def test_quality_reasons(spark):
    def doc(i, problems, total, stats=None, warnings=None, missing=False, carried=0):
        bars = [(["Voice odd"] if k < problems else ["Fermatas use it"] + (["The printed time signature could not be read confidently x"] if k < carried else []),) for k in range(total)]
        return (i, bars, stats or {}, warnings, missing)
    rows = [doc(1, 2, 20), doc(2, 6, 20), doc(3, 0, 20, carried=9), doc(4, 4, 4), doc(5, 0, 1, {"notes_matched": 90, "notes_unmatched": 10, "pages_without_regions": 1}), doc(6, 0, 0, missing=True)]
    df = spark.createDataFrame(rows, "doc_id int, measures array<struct<warnings: array<string>>>, stats map<string,bigint>, warnings array<string>, missing boolean")
    got = {r.doc_id: r for r in Q.timeline_quality(df).collect()}
    assert got[1].reasons == [] and got[2].reasons == ["6 of 20 measures have recognition warnings"] and got[4].reasons == []
    assert got[3].reasons == [] and len(got[3].sheet_warnings) == 1
    assert len(got[5].reasons) == 2 and got[6].reasons[0].startswith("No playback timeline")


def test_meter(spark):
    ev = [(1, 0, 0, "input", True, False), (1, 1_000, 1, "tick", True, False), (1, 90_000, 2, "tick", True, False), (1, 302_000, 3, "tick", True, False),
          (1, 303_000, 4, "tick", True, True), (1, 304_000, 5, "tick", False, True)]
    df = spark.createDataFrame(ev, "session_id int, at_ms long, seq int, kind string, visible boolean, playing boolean")
    got = {r.seq: (r.active_ms, r.playing_ms) for r in US.activity(df).collect()}
    assert got == {1: (1000, 0), 2: (5000, 0), 3: (3000, 0), 4: (1000, 1000), 5: (0, 0)}
    uses = spark.createDataFrame([(1, "speed", t, i) for i, t in enumerate([0, 1000, 1999, 2500, 3999, 4500, 9000])], "session_id int, control string, at_ms long, seq int")
    assert sorted(r.at_ms for r in US.debounce(uses).collect()) == [0, 2500, 4500, 9000]


def test_payments_of_the_store_that_bills(spark):
    from quaverlake.operators import payments as PY
    kind = ("id string, platform string, paid_at long, created_at long, amount double, refunded double, currency string, status string, plan string, plan_change boolean, "
            "period_start long, period_end long, subscription_id string")

    def paid(name, platform, at, subscription):
        return (name, platform, at, 5, 1.0, 0.0, "usd", "paid", None, False, None, None, subscription)
    accounts = spark.createDataFrame([("a", "apple", "s1"), ("b", "stripe", "s1"), ("c", None, "s2"), ("d", "apple", ""), ("e", "apple", None), ("f", "apple", "s9")],
                                     "user_id string, platform string, subscription_id string")
    store = spark.createDataFrame([paid("x", "apple", 10, "s1"), paid("y", "apple", 20, "s1"), paid("z", "apple", 30, "s2"), paid("e", "apple", 1, "")], kind)
    bills = spark.createDataFrame([paid("p", "stripe", None, "s1"), paid("q", "stripe", 7, "s2"), paid("r", "stripe", 7, "s2")], kind)
    got = {(r.user_id, r.place): r.id for r in PY.account_payments(accounts, store, bills).collect()}
    assert got == {("a", 1): "y", ("a", 2): "x", ("b", 1): "p", ("c", 1): "q", ("c", 2): "r"}


def test_stems_of_file_names(spark):
    from pathlib import PurePosixPath

    from quaverlake.functions.text import file_stem
    names = ["a.pdf", "x/y/b.tar.gz", ".hidden", ".a.b", "c", "d..e", "x.y/f", "g.pdf/", "h.pdf//", "i.pdf/.", "two\nlines.pdf", "end.pdf\n", "é ü.PDF", "", "/", "..", "  .x"]
    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", file_stem(F.col("n")).alias("s")).collect()}
    assert got == {n: PurePosixPath(n).stem for n in names}


def test_every_report_is_judged(spark, tmp_path):
    """A report of more seconds than are accepted has a verdict too."""
    import duckdb
    from oracle import compare

    from quaverlake.plans import all_queries, all_sql
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-02 10:00:00' + to_seconds(i) AS ts, i % 3 AS user_id,
                   CASE i % 2 WHEN 0 THEN 'view' ELSE 'error' END AS event_type, i * 173.5 AS value, '{"k": ' || i || '}' AS props FROM range(12) t(i)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    assert compare(all_queries()["P01_validate_reports"](spark, str(tmp_path)), con, all_sql()["P01_validate_reports"]) is None


def test_ranks_of_many_values(spark):
    """Approximate slices are computed once: the ranks are exact however often the rows are read."""
    from quaverlake.operators.ranks import percentile_ranks
    n = 60_000
    rows = spark.range(0, n, 1, 40).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") % 1_000_000_000).alias("v"))
    ranks = percentile_ranks(rows, "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95, "top": 1.0}, ["g"])
    assert "percentile_approx" not in ranks._jdf.queryExecution().toString()
    told = {r.g: (r.p10, r.p50, r.p95, r.top) for r in ranks.collect()}
    for g in (0, 1):
        v = sorted(r.v for r in rows.filter(F.col("g") == g).collect())
        assert told[g] == tuple(v[min(len(v) - 1, int(f * len(v)))] for f in (0.1, 0.5, 0.95, 1.0))


def test_ranks_of_a_missing_key(spark):
    from quaverlake.operators.ranks import percentile_rank
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "k string, v int")
    assert {(r.k, r.value) for r in percentile_rank(rows, "v", 0.5, ["k"]).collect()} == {(None, 2), ("a", 5)}


def test_lines_of_an_order_move_once(spark):
    """The notes of a document are placed by one exchange, and what groups by document finds them together."""
    from quaverlake.plans.page_queries import heads
    h = heads(spark, "/root/testdata/sf0.001")
    assert h.groupBy("doc_id", "page").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
