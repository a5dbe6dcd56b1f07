"""Streams that carry state: several micro-batches, restarts and late rows give what batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from quaverlake.operators import subscriptions as S
from quaverlake.operators.engagement import CONTROLS, sessions
from quaverlake.streaming import alarms as AL
from quaverlake.streaming import control as C
from quaverlake.streaming import stateful as SF
from quaverlake.streaming import usage as U
from quaverlake.streaming.versioned import VersionedTable

DAY = 86400


class Feed:
    """A folder that files are added to; each file is a micro-batch of its own."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.files, self.rows = spark, path, schema, 0, []

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in/{self.files:04d}")
        self.files += 1
        self.rows += rows

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{self.path}/in")

    def table(self):
        return self.spark.createDataFrame(self.rows, self.schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def state_rows(spark, root):
    """Rows that the state store holds now, timers left out."""
    return spark.read.format("statestore").option("path", f"{root}/state").option("stateVarName", "session").load().count()


REPORT = ("user_id string, session_id string, job_id string, surface string, platform string, seconds long, playing_seconds long, admin boolean, at long, seq long, "
          + ", ".join(f"e_{c} long" for c in CONTROLS))


def report(user, session, at, seq, job="j", seconds=5, admin=None):
    return (user, session, job, "sheet", "web", seconds, None, admin, at, seq, *[1 if k == seq % len(CONTROLS) else 0 for k in range(len(CONTROLS))])


def test_sessions_expire_and_a_restart_goes_on(spark, tmp_path):
    feed, root = Feed(spark, str(tmp_path), REPORT), f"{tmp_path}/run"
    feed.add([report("u1", "a", 1000, 1, "first"), report("u1", "b", 2000, 2, admin=True), report("u2", "a", 1500, 3, seconds=None)])
    feed.add([report("u1", "a", 900, 4, "earlier"), report("u1", "a", 1100, 5)])
    got = SF.session_table(feed.stream(), root, late="30 days")
    assert rows_of(got) == rows_of(sessions(feed.table()))
    assert state_rows(spark, root) == 3
    # A restart over new files: the state is still there, and still equals batch.
    feed.add([report("u1", "b", 2000 + 10 * DAY, 6), report("u3", "c", 20 * DAY, 7)])
    got = SF.session_table(feed.stream(), root, late="30 days")
    assert rows_of(got) == rows_of(sessions(feed.table()))
    assert state_rows(spark, root) == 4
    # 400 days later the first three are gone from state and table, though nothing came for them.
    feed.add([report("u9", "z", 432 * DAY, 8)])
    feed.add([report("u9", "z", 433 * DAY, 9)])
    got = SF.session_table(feed.stream(), root, late="30 days")
    now = 433 * DAY - 30 * DAY
    assert rows_of(got) == rows_of(sessions(feed.table()).where(F.col("expires_at") > now))
    assert state_rows(spark, root) == 2
    # A report for an expired name begins a new session.
    feed.add([report("u1", "a", 434 * DAY, 10, "again")])
    feed.add([report("u9", "z", 435 * DAY, 11)])
    again = SF.session_table(feed.stream(), root, late="30 days").where("user_id = 'u1' AND session_id = 'a'").collect()
    assert [(r.job_id, r.started_at, r.reports) for r in again] == [("again", 434 * DAY, 1)]


class _Handle:
    """State and timers of one key, and how often they are asked for."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], 0

    def getListState(self, name, schema):
        return self

    def _call(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self._call(iter(list(self.rows)))

    def put(self, rows):
        self._call(self.rows.__setitem__(slice(None), rows))

    def appendList(self, rows):
        self._call(self.rows.extend(rows))

    def registerTimer(self, at):
        self._call(self.timers.append(at))

    def deleteTimer(self, at):
        self._call(self.timers.remove(at))


def test_state_is_asked_for_once_a_person():
    names = [c.split()[0] for c in REPORT.split(", ")]
    handle, sessions_of_one = _Handle(), SF._Sessions(10)
    sessions_of_one.init(handle)
    for start in (0, 20):
        rows = [dict(zip(names, report("u", f"s{start + k}", 1000 + start + k, k))) for k in range(40)]
        got = list(sessions_of_one.handleInputRows(("u",), iter(rows), None))
        assert len(got) == 40
    assert [r["session_id"] for r in got] == [f"s{k}" for k in range(20, 60)] and [r["reports"] for r in got] == [2] * 20 + [1] * 20
    assert len(handle.rows) == 60 and handle.timers == [1_010_000]
    assert handle.calls == 5  # two reads, two writes, one timer


def test_alarms_close_without_input(spark, tmp_path):
    schema = "dimension string, at timestamp, value double"
    feed, root = Feed(spark, str(tmp_path), schema), f"{tmp_path}/run"
    rng = random.Random(4)
    t = [(d, k) for d in ("queue", "dlq") for k in range(0, 3600, 20)]
    rows = [(d, k, rng.choice([0.0, 950.0, 990.0, None]) if (k // 240) % 3 else 995.0) for d, k in t if not 900 <= k < 1150 and not (d == "dlq" and 2000 <= k < 2700)]
    import datetime
    rows = [(d, datetime.datetime.fromtimestamp(k, datetime.timezone.utc), v) for d, k, v in rows]
    order = sorted(rows, key=lambda r: r[1].timestamp() + rng.random() * 100)
    for i in range(0, len(order), 60):
        feed.add(order[i:i + 60])
    end = (("clock", datetime.datetime.fromtimestamp(9000, datetime.timezone.utc), 0.0),)
    feed.add(list(end))
    for statistic, needed in (("Maximum", 2), ("Average", 1), ("Sum", 3)):
        run = f"{root}/{statistic}"
        changes = SF.run_stateful(SF.alarm_stream(feed.stream(), statistic, "GreaterThanThreshold", 600, needed, 60, "3 minutes"), root=run)
        periods = AL.period_values(feed.table(), statistic, 60)
        want = AL.alarm_changes(AL.alarms(periods, "GreaterThanThreshold", 600, needed))
        assert rows_of(changes.where("state = 'ok'").drop("state")) == rows_of(want)
        on, off = changes.where("state = 'alarm'"), changes.where("state = 'ok'")
        assert rows_of(on.select("dimension", "first_period")) == rows_of(off.select("dimension", "first_period"))


def test_meter_reads_shuffled_events_in_order(spark, tmp_path):
    schema = "session_id string, at_ms long, seq long, kind string, visible boolean, playing boolean"
    feed, root = Feed(spark, str(tmp_path), schema), f"{tmp_path}/run"
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(6)}", rng.randrange(0, 1_500_000), i, rng.choice(["tick", "tick", "input", "count"]), rng.random() < 0.8, rng.random() < 0.2) for i in range(900)]
    rows += [("s0", 5000, 2000 + i, "tick", True, False) for i in range(5)]
    rng.shuffle(rows)
    for i in range(3):  # shuffled over three files: the watermark must wait for the whole span
        feed.add(rows[i::3])
    feed.add([("end", 4_000_000, 1, "input", True, False)])
    first = SF.run_stateful(SF.activity_stream(feed.stream(), "30 minutes"), root=root)
    assert rows_of(first.select("session_id", "seq", "active_ms", "playing_ms")) == rows_of(U.activity(feed.table()).select("session_id", "seq", "active_ms", "playing_ms"))
    # After a restart the clock of a session goes on; an event older than the watermark is dropped.
    feed.add([("s1", 4_100_000, 3000, "tick", True, False), ("s1", 100, 3001, "tick", True, True)])
    feed.add([("end", 9_000_000, 3002, "input", True, False)])
    second = SF.run_stateful(SF.activity_stream(feed.stream(), "30 minutes"), root=root)
    want = U.activity(feed.table().where("seq <> 3001")).select("session_id", "seq", "active_ms", "playing_ms")
    assert rows_of(second.select("session_id", "seq", "active_ms", "playing_ms")) == rows_of(want)


def test_revisions_over_several_batches(spark, tmp_path):
    schema = "job_id string, user_id string, seq long, revision long"
    feed, root = Feed(spark, str(tmp_path), schema), f"{tmp_path}/run"
    rng = random.Random(11)
    rows = [(f"j{rng.randrange(3)}", f"u{rng.randrange(2)}", i, rng.choice([i // 30, i // 40, 0, 1, 2])) for i in range(240)]
    for i in range(0, 240, 48):
        feed.add(rows[i:i + 48])
        if i == 96:
            SF.run_stateful(SF.revision_stream(feed.stream()), root=root)
    got = SF.run_stateful(SF.revision_stream(feed.stream()), root=root)
    want = C.accept_revisions(feed.table())
    assert rows_of(got) == rows_of(want)
    assert got.where("accepted").count() > 10


UPDATE = ("user_id string, at long, seq long, status string, plan string, platform string, subscription_id string, started_at long, current_period_start long, current_period_end long, "
          "cancel_at_period_end boolean, canceled_at long, ended_at long")


def updates(n, seed):
    rng = random.Random(seed)
    return [(f"u{rng.randrange(12)}", 1000 * i, i, rng.choice(["active", "trialing", "past_due", "canceled", "expired"]), "monthly", "stripe", rng.choice([None, f"s{i}"]), rng.choice([None, i]),
             None, i * 7, rng.choice([True, False, None]), rng.choice([None, 0, i * 10]), rng.choice([None, None, i * 11])) for i in range(n)]


def plain_fold(rows):
    """Each update applied in turn."""
    table = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        old = table.get(r[0], {})
        ended = r[3] in ("canceled", "expired")
        row = {"user_id": r[0], "status": r[3], "plan": r[4], "platform": r[5], "current_period_start": r[8], "current_period_end": r[9], "cancel_at_period_end": r[10], "updated_at": r[1],
               "subscription_id": r[6] if r[6] is not None else old.get("subscription_id"), "started_at": r[7] if r[7] is not None else old.get("started_at")}
        row["canceled_at"] = (r[11] or old.get("canceled_at") or r[1]) if r[10] or ended else None
        row["ended_at"] = (r[12] or old.get("ended_at") or r[1]) if ended else None
        table[r[0]] = row
    return sorted((tuple(row[c] for c in sorted(row)) for row in table.values()), key=repr)


@pytest.mark.parametrize("chunk", [3000, 10**9])
def test_fold_in_chunks_equals_one_update_after_another(spark, chunk):
    rows = updates(400, 2)
    assert rows_of(S.fold_events(spark.createDataFrame(rows, UPDATE), chunk)) == plain_fold(rows)


def test_subscription_table_of_several_batches(spark, tmp_path):
    feed, root = Feed(spark, str(tmp_path), UPDATE), f"{tmp_path}/run"
    rows = updates(300, 5)
    for part in (rows[:100], rows[100:160]):
        feed.add(part)
    table = C.subscription_table(feed.stream(), root, buckets=4)
    assert rows_of(table.read()) == plain_fold(rows[:160])
    for part in (rows[160:161], rows[161:]):
        feed.add(part)
    table = C.subscription_table(feed.stream(), root, buckets=4)
    assert rows_of(table.read()) == plain_fold(rows)
    assert table.versions() == [1, 2, 3]
    assert rows_of(table.read(2)) == plain_fold(rows[:161])
    # The last batch once more: nothing changes.
    before = rows_of(table.read())
    table.apply(spark.createDataFrame(rows[161:], UPDATE), 3, C.fold_into)
    assert rows_of(table.read()) == before and table.versions() == [1, 2, 3]
    # A batch without rows is a version like the one before it.
    table.apply(spark.createDataFrame([], UPDATE), 4, C.fold_into)
    assert rows_of(table.read()) == before


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, n long").schema
    table = VersionedTable(spark, f"{tmp_path}/t", schema, ("k",), buckets=3, keep=2)

    def add(rows, new):
        return rows.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))

    table.apply(spark.createDataFrame([(i, 1) for i in range(9)], schema), 0, add)

    def broken(rows, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.apply(spark.createDataFrame([(1, 5)], schema), 1, broken)
    assert rows_of(table.read()) == [(i, 1) for i in range(9)]
    spark.createDataFrame([(1, 99, 0)], "k long, n long, bucket int").write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/batch=1")  # no manifest points here
    table.apply(spark.createDataFrame([(1, 5)], schema), 1, add)
    assert rows_of(table.read()) == [(i, 6 if i == 1 else 1) for i in range(9)]
    table.apply(spark.createDataFrame([(2, 5)], schema), 2, add)
    assert table.versions() == [1, 2] and rows_of(table.read(1)) == [(i, 6 if i == 1 else 1) for i in range(9)]


def test_alerts_see_a_changed_table(spark, tmp_path):
    feed, root, side = Feed(spark, str(tmp_path), "job_id string, status string, error string"), f"{tmp_path}/run", f"{tmp_path}/quality"

    def quality(s):
        return s.read.schema("job_id string, reasons array<string>").parquet(side)

    spark.createDataFrame([("a", ["blurred"]), ("b", [])], "job_id string, reasons array<string>").write.parquet(side)
    feed.add([("a", "done", None), ("b", "done", None), ("c", "failed", "crash"), ("d", "failed", None)])
    assert rows_of(C.alert_stream(feed.stream(), quality, root).select("job_id", "event", "reasons")) == [
        ("job_done", "a", ["blurred"]), ("job_failed", "c", ["crash"]), ("job_failed", "d", ["unknown error"])]
    spark.createDataFrame([("b", ["cut off"])], "job_id string, reasons array<string>").write.mode("overwrite").parquet(side)
    feed.add([("b", "done", None), ("a", "done", None)])
    got = C.alert_stream(feed.stream(), quality, root)
    assert got.count() == 4 and got.where("job_id = 'b'").first().reasons == ["cut off"]
