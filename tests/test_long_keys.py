"""Short keys are scanned by plain windows, long ones in chunks, with one result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quaverlake.operators import performed as P
from quaverlake.operators import ranks as R
from quaverlake.operators import segments as X
from quaverlake.plans import all_queries

SF = "/root/testdata/sf0.001"


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_chunks_only_where_a_key_is_long(spark):
    df = spark.range(60).select(F.when(F.col("id") < 40, 1).otherwise(F.col("id")).alias("k"), "id")
    assert X.for_long(df, ["k"], 64.0) is None
    assert X.for_long(df, ["k"], 64.0, most=40) is None
    assert X.for_long(df, ["k"], 64.0, most=39) == 64.0
    assert X.for_long(df.limit(0), ["k"], 64.0, most=0) is None
    # two keys of one bucket are no long key
    many = spark.range(60_000).select("id")
    assert X.for_long(many, ["id"], 64.0, most=3) is None


def test_null_keys_count_as_one(spark):
    df = spark.range(50).select(F.lit(None).cast("long").alias("k"))
    assert X.for_long(df, ["k"], 1.0, most=49) == 1.0
    assert X.for_long(df, ["k"], 1.0, most=50) is None


@pytest.mark.parametrize(("name", "most"), [("W12_merge_ties", 1), ("W13_sounding_events", 1), ("W18_name_spans", 4)])
def test_lines_of_short_orders_move_few_times(spark, name, most):
    assert _exchanges(all_queries()[name](spark, SF)) <= most


def test_ties_by_plain_windows_and_in_chunks_are_one(spark):
    rows = [(d, 0, 1, 60, f"{i:04d}", i * 0.5, 0.5, 0.5, 64, i % 3 != 2, i % 3 != 0) for d in (1, 2) for i in range(200)]
    notes = spark.createDataFrame(rows, "d long, part long, voice long, midi long, source_id string, start_beat double, duration double, key_duration double, "
                                  "velocity long, tie_start boolean, tie_stop boolean")
    plain, cut = (sorted(map(str, P.merge_ties(notes, ["d"], w).collect())) for w in (None, 7.0))
    assert plain == cut and len(plain) == 2 * 67


def test_ranks_of_short_keys_are_written_once(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1009).alias("v"))
    wrote, plain = [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda d: wrote.append(1) or plain(d))
    short = sorted(map(str, R.upper_median(df, "v", ["k"]).collect()))
    all_rows = R.upper_median(df, "v").collect()
    assert len(wrote) == 2
    monkeypatch.setattr(R, "_SLICED_FROM", 100)
    assert sorted(map(str, R.upper_median(df, "v", ["k"]).collect())) == short and len(short) == 3
    assert R.upper_median(df, "v").collect() == all_rows
