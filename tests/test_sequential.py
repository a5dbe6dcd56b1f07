"""Operators whose meaning is a sequential pass, on small tables with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from quaverlake.operators import align as A
from quaverlake.operators import geometry as G
from quaverlake.operators import performed as P
from quaverlake.operators import quality as Q
from quaverlake.operators import ranks as R
from quaverlake.operators import segments as X
from quaverlake.operators import written as W
from quaverlake.operators.assign import greedy_assign
from quaverlake.streaming import usage as U


@pytest.fixture
def rng():
    return random.Random(7)


def test_chunked_scans_equal_plain_windows(spark, rng):
    rows = [(k, i, rng.choice([None, rng.randint(-5, 5)])) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    chunk = X.chunk_of("i", 7)
    for scan in (X.running_sum, X.carry_last, X.carry_next, X.running_max, X.running_min):
        plain = scan(df, ["k"], ["i"], F.col("v"), "o").select("k", "i", "o")
        cut = scan(df, ["k"], ["i"], F.col("v"), "o", chunk).select("k", "i", "o")
        assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, cut.collect()), key=repr), scan.__name__


def test_ranks(spark, rng):
    data = {k: [rng.randint(0, 30) for _ in range(n)] for k, n in (("a", 11), ("b", 10), ("c", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v long")
    got = {r.k: r for r in R.percentile_ranks(df, "v", {"p50": 0.5, "p95": 0.95}, ["k"]).collect()}
    med = {r.k: r["median"] for r in R.exact_median(df, "v", ["k"]).collect()}
    for k, vs in data.items():
        s, n = sorted(vs), len(vs)
        assert got[k].p50 == s[min(n - 1, int(0.5 * n))] and got[k].p95 == s[min(n - 1, int(0.95 * n))]
        assert med[k] == (s[(n - 1) // 2] + s[n // 2]) / 2


def test_greedy_assign(spark, rng):
    pairs = [(a, b, rng.randint(0, 9)) for a in range(12) for b in range(12) if rng.random() < 0.5]
    got = {(r.a, r.b) for r in greedy_assign(spark.createDataFrame(pairs, "a int, b int, cost int"), "a", "b", ["cost"]).collect()}
    left, right, want = set(), set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    assert got == want


def test_link_by_position_makes_few_pairs(spark, rng, monkeypatch):
    points = [(i, rng.randint(0, 80) / 2, rng.randint(0, 80) / 2, i % 2) for i in range(400)]
    heads = [(i, rng.randint(0, 80) / 2, rng.randint(0, 80) / 2, i % 2) for i in range(350)]
    made = []
    monkeypatch.setattr(G, "greedy_assign", lambda pairs, *a: made.append(pairs.count()) or greedy_assign(pairs, *a))
    odd = [(None, 1.0, 1.0, 0), (900, None, 1.0, 0), (901, 1.0, float("nan"), 0), (902, 1.0, 1.0, None)]
    got = G.link_by_position(spark.createDataFrame([(0, *p) for p in points + odd], "page int, label_id int, x double, y double, pc int"),
                             spark.createDataFrame([(0, *h) for h in heads + odd], "page int, head_id int, hx double, hy double, hpc int"), ["page"])
    cost = sorted((2 * abs(x - hx) + abs(y - hy), a, b) for a, x, y, pc in points for b, hx, hy, hpc in heads if pc == hpc and abs(x - hx) <= 16 and abs(y - hy) <= 45)
    left, right, want = set(), set(), set()
    for c, a, b in cost:
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b, c))
    assert {(r.label_id, r.head_id, r.cost) for r in got.collect()} == want
    assert len(made) > 1 and sum(made) < len(cost) / 4  # not every pair inside the gates is made


def test_link_labels_shuffles_no_pairs(spark, rng):
    places = [(rng.randint(-60, 60) / 2, rng.randint(-60, 60) / 2) for _ in range(300)]
    labels = [(i % 2, i, *places[i]) for i in range(120)] + [(0, 900, None, 1.0), (None, 901, 1.0, 1.0), (5, 902, 1.0, 1.0)]
    notes = [(i % 2, f"n{i // 3}", 1000 - i, *places[i]) for i in range(300)] + [(0, "none", 1, 1.0, None), (None, "none", 1, 1.0, 1.0)]  # copies of a note at three places
    got = G.link_labels(spark.createDataFrame(labels, "page int, label_id int, x double, y double"),
                        spark.createDataFrame(notes, "page int, note_id string, seq int, nx double, ny double"), ["page"], 9.0)
    want = {}
    for page, label, x, y in labels:
        near = sorted((seq, n) for p, n, seq, nx, ny in notes if None not in (p, x, ny) and p == page and ((x - nx) ** 2 + (y - ny) ** 2) ** 0.5 <= 9)
        want[label] = list(dict.fromkeys(n for _, n in near))
    assert {r.label_id: r.notes for r in got.collect()} == want and max(map(len, want.values())) > 10
    assert got._jdf.queryExecution().analyzed().toString().count("Aggregate [") == 1  # notes of a cell; pairs are not gathered by a shuffle


def test_carry_direction(spark):
    marks = [  # y, x, direction, sign, one line, at edge, label at edge; the direction it ends with
        (0.0, 5.0, 1, 1, True, True, False, 1), (1.0, 5.0, None, -1, True, True, False, 1), (2.0, 5.0, None, 1, True, False, False, 1),
        (3.0, 5.0, None, -1, True, True, False, None), (4.0, 5.0, None, 1, False, True, True, -1), (5.0, 5.0, None, 1, False, True, False, -1),
        (6.0, 5.0, None, 1, True, False, False, None), (7.0, 9.0, None, 1, True, True, False, -1), (8.0, 1.0, -1, 1, True, False, False, -1),
        (9.0, 1.0, None, 1, True, False, False, None), (10.0, 5.0, 1, 1, True, True, False, 1), (11.0, 5.0, None, None, True, True, False, 1),  # a line of no staff clears
        (12.0, 5.0, None, 1, True, False, False, None)]
    df = spark.createDataFrame([(0, *m[:7]) for m in marks], "page int, y double, x double, direction int, sign int, one_line boolean, at_edge boolean, label_at_edge boolean")
    for chunk in (None, X.chunk_of("y", 3)):
        assert [r.direction for r in G.carry_direction(df, ["page"], chunk).orderBy("y", "x").collect()] == [m[7] for m in marks]

def test_match_tiered(spark):
    hs = spark.createDataFrame([(0, 0, "a", 0.0, 3, "1", 1.0), (0, 0, "b", 1.0, 3, "1", 2.0), (0, 0, "c", 1.0, 3, "2", 3.0), (0, 0, "d", 2.0, 10, "1", 4.0),
                                (0, 0, "e", 3.0, 4, "1", 5.0), (0, 0, "f", 3.0, 4, "1", 6.0), (0, 0, "g", None, 5, "1", 8.0), (0, 0, "h", None, 5, "1", 7.0), (0, 1, "i", 0.0, 3, "1", 9.0)],
                               "m int, role int, source_id string, onset double, pitch int, voice string, x double")
    rows = [(0, 0, "n0", 0, 0.0, "1", False, 3, 3), (0, 0, "n1", 1, 1.0, "2", False, 3, 3),  # of two at one place, the own voice
            (0, 0, "n2", 2, 2.0, "1", False, 3, 3),  # an octave off
            (0, 0, "n3", 3, 3.0, "1", False, 4, 4),  # two alike: none
            (0, 0, "n4", 4, 0.0, "1", True, 5, 5), (0, 0, "n5", 5, 0.0, "1", True, 5, 5), (0, 0, "n6", 6, 0.0, "1", True, 5, 5),  # graces from the left, then none
            (0, 0, "n7", 7, 0.0, "2", False, 3, 3),  # shares the used head
            (0, 1, "n8", 8, 0.0, "1", False, 10, 3)]  # by its sounding place
    ns = spark.createDataFrame(rows, "m int, role int, note_id string, seq int, start double, voice string, is_grace boolean, written_slot int, sounding_slot int")
    got = {r.note_id: r.head_id for r in A.match_tiered(ns, hs, ["m"]).collect()}
    assert got == {"n0": "a", "n1": "c", "n2": "d", "n3": None, "n4": "h", "n5": "g", "n6": None, "n7": "a", "n8": "i"}

def test_match_tiered_in_one_pass(spark, rng, monkeypatch):
    """Groups are folded without rounds; rounds, for groups of many rows, give the same."""
    hs = spark.createDataFrame([(i % 5, i % 2, f"h{i:03}", rng.choice([None, 0.0, 1.0]), rng.choice([3, 10, 4]), rng.choice("12"), rng.random()) for i in range(120)],
                               "m int, role int, source_id string, onset double, pitch int, voice string, x double").cache()
    ns = spark.createDataFrame([(i % 5, i % 2, f"n{i:03}", i, rng.choice([0.0, 1.0]), rng.choice("12"), rng.random() < 0.3, rng.choice([3, 10, 4]), rng.choice([3, 4])) for i in range(120)],
                               "m int, role int, note_id string, seq int, start double, voice string, is_grace boolean, written_slot int, sounding_slot int").cache()

    def found(few):
        return {r.note_id: r.head_id for r in A.match_tiered(ns, hs, ["m"], few).collect()}

    rounds = []
    monkeypatch.setattr(A, "cut_lineage", lambda df, cut=A.cut_lineage: rounds.append(df) or cut(df))
    folded = found(True)
    assert not rounds and len(folded) == 120 and len(set(folded.values())) > 20
    monkeypatch.setattr(A, "FEW", 5)
    monkeypatch.setattr(A, "for_long", lambda df, keys, chunk, most: X.for_long(df, keys, chunk, 5))
    assert found(False) == folded and rounds


def test_repeats_with_endings(spark):
    #          fwd    back ends          bars 0..8
    bars = [(False, 0, []), (False, 0, []), (False, 2, [1]), (False, 0, [2]), (True, 0, []), (False, 3, []), (False, 0, []), (False, 0, [1]), (False, 0, [])]
    df = spark.createDataFrame([(0, i, *b) for i, b in enumerate(bars)], "d int, measure_index int, repeat_forward boolean, repeat_backward int, endings array<int>")
    for chunk in (None, X.chunk_of("measure_index", 2)):
        played = W.performance_position(W.expand_repeats(df, ["d"], chunk=chunk), ["d"]).orderBy("position").collect()
        assert [r.measure_index for r in played] == [0, 1, 2, 0, 1, 3, 4, 5, 4, 5, 4, 5, 6, 7, 8]
        assert [r.measure_index for r in played if r.orphan_ending] == [7]


@pytest.mark.parametrize("bars, want", [
    ("F ; B2e1 ; e2 ; . ; B2", [0, 1, 0, 2, 3, 4, 3, 4]),  # after an earlier repeat and the endings that close it
    (". ; | ; . ; B2", [0, 1, 2, 3, 2, 3]),  # after a double bar line
    (". ; | ; k ; B2", [0, 1, 2, 3, 0, 1, 2, 3]),  # that no new key follows
    ("F ; F ; B2 ; B2", [0, 1, 2, 1, 2, 3, 0, 1, 2, 1, 2, 3]),  # nested
    ("B2 ; . ; s ; . ; B3", [0, 0, 1, 2, 3, 4, 2, 3, 4, 2, 3, 4]),  # a bar that opens a section
    ("B2 ; . ; sk ; B2", [0, 0, 1, 2, 3, 1, 2, 3]),  # not with a new key
    ("F ; B2 ; B2 ; B2", [0, 1, 0, 1, 2, 2, 3, 3]),  # more backward signs than forward ones
    ("e1 ; e2 ; .", [0, 1, 2])])
def test_repeats_go_back_to_their_section(spark, bars, want):
    rows = []
    for i, b in enumerate(bars.split(" ; ")):
        rows.append((0, i, "F" in b, int(b[b.index("B") + 1]) if "B" in b else 0, [int(b[b.index("e") + 1])] if "e" in b else [], "s" in b, "|" in b, "k" in b))
    df = spark.createDataFrame(rows, "d int, measure_index int, repeat_forward boolean, repeat_backward int, endings array<int>, section_start boolean, section_end boolean, signature boolean")
    for chunk, width in ((None, None), (X.chunk_of("measure_index", 2), 2)):
        played = W.performance_position(W.expand_repeats(df, ["d"], chunk=chunk, chunk_width=width), ["d"]).orderBy("position").collect()
        assert [r.measure_index for r in played] == want


def test_bar_times_of_graces_and_fermatas(spark):
    notes = [(0, 0, "1", "g", 0, 1.0, 0.0, True, False, 0.5, None, None, False), (0, 0, "1", "a", 1, 1.0, 1.0, False, False, None, None, None, True),
             (0, 0, "1", "b", 2, 2.0, 2.0, False, False, None, None, None, False), (0, 0, "2", "low", 3, 0.0, 4.0, False, False, None, None, None, False),
             (1, 0, "1", "c1", 0, 0.0, 0.0, True, False, 3.0, None, None, False)]
    n = spark.createDataFrame(notes, "m int, part int, voice string, note_id string, seq int, start double, duration double, is_grace boolean, chord boolean, make_time double, "
                                     "steal_previous double, steal_following double, fermata boolean")
    e = spark.createDataFrame([(0, 1, 0.5), (0, 2, 1.0), (0, 3, 2.0), (0, 4, 3.0), (1, 5, 0.0)], "m int, event_id int, beat double")
    b = spark.createDataFrame([(0, 4.0), (1, 4.0), (2, 4.0)], "m int, length double")
    got, events, lengths = P.realize_bars(n, e, b, ["m"])
    # Half a beat goes in at beat 1; the fermata on a holds half a beat at its end, now 2.5; the cadenza alone is its bar.
    assert {r.note_id: (r.start, r.duration) for r in got.collect()} == {"g": (1.0, 0.5), "a": (1.5, 1.5), "b": (3.0, 2.0), "low": (0.0, 5.0), "c1": (0.0, 3.0)}
    assert {r.event_id: r.beat for r in events.collect()} == {1: 0.5, 2: 1.5, 3: 3.0, 4: 4.0, 5: 3.0}
    assert {r.m: r.length for r in lengths.collect()} == {0: 5.0, 1: 3.0, 2: 4.0}


def test_fermata_hold(spark):
    notes = [(0, "a", 0.0, 2.0, True), (0, "b", 2.0, 1.0, False), (0, "c", 1.0, 4.0, False), (0, "d", 3.0, 0.5, True), (0, "e", 3.5, 0.5, False),
             (1, "f", 0.0, 8.0, True), (1, "g", 8.0, 1.0, False), (1, "h", 0.0, 1.0, False)]
    df = spark.createDataFrame(notes, "m int, note_id string, start double, duration double, fermata boolean")
    got = {r.note_id: (r.start, r.duration) for r in P.fermata_hold(df, ["m"]).collect()}
    # a holds one beat more at beat 2; d, now at 4 to 4.5, half a beat at its end (no less); f two beats (no more)
    assert got == {"a": (0.0, 3.0), "b": (3.0, 1.0), "c": (1.0, 5.5), "d": (4.0, 1.0), "e": (5.0, 0.5), "f": (0.0, 10.0), "g": (10.0, 1.0), "h": (0.0, 1.0)}

def _graces(spark, rows):
    return spark.createDataFrame(rows, "m int, part int, voice string, note_id string, seq int, start double, duration double, is_grace boolean, chord boolean, "
                                       "make_time double, steal_previous double, steal_following double")


def _reads(df):
    """How often a result reads its tables."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_restore_deficit_reads_few_times(spark):
    hs = spark.createDataFrame([(0, 0, "a", 0.0, 60, "1", 1.0, False), (0, 0, "b", 0.0, 62, "1", 2.0, False), (0, 0, "c", 1.0, 64, "1", 3.0, False), (0, 0, "d", 1.0, 64, "1", 4.0, True),
                                (0, 0, "e", 3.0, 65, None, 5.0, False), (0, 0, "f", 3.0, None, "2", 6.0, False)],
                               "m int, role int, source_id string, onset double, midi int, voice string, cx double, used boolean")
    ns = spark.createDataFrame([(0, 0, 0.0, 60, "1", 0.5), (0, 0, 1.0, 64, None, 9.0), (0, 0, 3.0, None, "2", 0.25)], "m int, role int, start double, midi int, voice string, duration double")
    got = A.restore_deficit(hs, ns, spark.createDataFrame([(0, 4.0)], "m int, length double"), ["m"])
    # b: its pitch is missing, as long as its voice's note; c: one of two heads; e: to the end of the bar; f's note has no pitch, so both heads there are open
    assert sorted((r.source_id, r.start, r.duration, r.voice) for r in got.collect()) == [("b", 0.0, 0.5, "1"), ("c", 1.0, 2.0, "1"), ("e", 3.0, 1.0, "1")]
    assert _reads(got) == 3


def test_funnel_reads_heads_once(spark):
    h = spark.createDataFrame([(0, 0, 1.0, True), (0, 0, None, False), (0, 1, 2.0, None), (1, 0, None, True)], "d int, page int, onset double, kept boolean")
    printed = F.when(F.col("d") == 0, F.count(F.lit(1)) + 1)
    got = Q.funnel(h, F.col("kept"), ~F.col("kept"), printed, ["d", "page"])
    frames = Q.funnel(h, h.where("kept"), h.where("NOT kept"), h.groupBy("d", "page").agg(printed.alias("printed")), ["d", "page"])
    mixed = Q.funnel(h, F.col("kept"), h.where("NOT kept"), printed, ["d", "page"])
    assert _reads(got) == 1
    assert sorted(got.collect()) == sorted(frames.collect()) == sorted(mixed.collect()) and sorted(got.collect())[0] == (0, 0, 3, 2, 1, 1, 1)


def test_grace_timing_reads_few_times(spark):
    rows = [(0, 0, "1", "g", 0, 1.0, 0.0, True, False, 0.5, None, None), (0, 0, "1", "a", 1, 1.0, 1.0, False, False, None, None, None),
            (0, 0, "2", "b", 2, 0.0, 4.0, False, False, None, None, None), (1, 0, "1", "c", 0, 0.0, 4.0, False, False, None, None, None)]
    notes, inserts = P.grace_timing(_graces(spark, rows), ["m"])
    assert _reads(notes) <= 5 and _reads(inserts) == 1
    # A voice and a bar without graces go through; a voice beside one is moved by the time it makes.
    assert {r.note_id: (r.start, r.duration) for r in notes.collect()} == {"g": (1.0, 0.5), "a": (1.5, 1.0), "b": (0.0, 4.5), "c": (0.0, 4.0)}


def test_grace_timing(spark):
    rows = [(0, 0, "1", "g1", 0, 0.0, 0.0, True, False, None, None, None), (0, 0, "1", "g2", 1, 0.0, 0.0, True, False, None, None, None),
            (0, 0, "1", "a", 2, 0.0, 2.0, False, False, None, None, None), (0, 0, "1", "c", 3, 0.0, 2.0, False, True, None, None, None),
            (0, 0, "1", "g3", 4, 2.0, 0.0, True, False, None, 50.0, None), (0, 0, "1", "b", 5, 2.0, 1.0, False, False, None, None, None),
            (1, 0, "1", "g4", 0, 1.0, 0.0, True, False, 0.5, None, None), (1, 0, "1", "d", 1, 1.0, 1.0, False, False, None, None, None),
            (1, 0, "2", "e", 2, 0.0, 2.0, False, False, None, None, None)]
    notes, inserts = P.grace_timing(_graces(spark, rows), ["m"])
    got = {r.note_id: (r.start, r.duration) for r in notes.collect()}
    assert got["g1"] == (0.0, 0.125) and got["g2"] == (0.125, 0.125)
    assert got["a"] == (0.25, 0.875) and got["c"] == (0.25, 0.875)  # a quarter beat later, then half given to g3
    assert got["g3"] == (1.125, 0.875) and got["b"] == (2.0, 1.0)
    assert got["g4"] == (1.0, 0.5) and got["d"] == (1.5, 1.0) and got["e"] == (0.0, 2.5)
    assert [(r.m, r["at"], r.amount) for r in inserts.collect()] == [(1, 1.0, 0.5)]


def test_uniform_run_and_tail(spark):
    heads = spark.createDataFrame([(0, 0, f"h{i}", 10.0 * i, 0.9, False, "NOTEHEAD_BLACK", True) for i in range(4)],
                                  "m int, role int, source_id string, cx double, confidence double, uncertain boolean, shape string, vector boolean")
    notes = spark.createDataFrame([(0, 0, h, float(i), 1.0, "1", False) for i, h in enumerate(["h0", "h2", "h3"])],
                                  "m int, role int, head_id string, start double, duration double, voice string, irregular boolean")
    bars = spark.createDataFrame([(0, 4.0)], "m int, length double")
    rests = spark.createDataFrame([], "m int, role int, start double, duration double")
    got = {r.source_id: (r.start, r.recovered) for r in A.uniform_runs(heads, notes, bars, rests, ["m"]).collect()}
    assert got == {"h0": (0.0, False), "h1": (1.0, True), "h2": (2.0, False), "h3": (3.0, False)}
    resting = spark.createDataFrame([(0, 0, 1.0, 1.0)], rests.schema)
    assert A.uniform_runs(heads, notes, bars, resting, ["m"]).isEmpty()
    tail_heads = heads.drop("vector").withColumns({"chord_id": F.lit(None).cast("string"), "onset": F.lit(None).cast("double"),
                                                   "voice": F.lit(None).cast("string"), "used": F.col("source_id") != "h3"})
    first = spark.createDataFrame([(0, 0, f"h{i}", float(i), 1.0, "1", False) for i in range(3)], notes.schema)
    assert [(r.source_id, r.start, r.voice) for r in A.extend_tail(tail_heads, first, bars, rests, ["m"]).collect()] == [("h3", 3.0, "1")]
    assert A.extend_tail(tail_heads, first, bars.withColumn("length", F.lit(5.0)), rests, ["m"]).isEmpty()
    assert _reads(A.extend_tail(tail_heads, first, bars, rests, ["m"])) <= 6


def test_choose_variants(spark):
    cols = "page int, count int, placed double, longest_bar double, quality double, positioned int, unverified int"
    old = spark.createDataFrame([(1, 100, 0.5, 8.0, 0.6, None, None), (2, 100, 0.5, 8.0, 0.6, 50, 50)], cols)
    variants = spark.createDataFrame([
        (1, 0, True, 100, 0.6, 30.0, 0.9, None, None), (1, 1, True, 100, 0.99, 8.0, 0.9, None, None),   # wild bars; passed over after no gain
        (1, 2, False, 100, 0.7, 8.0, 0.7, None, None), (1, 3, False, 100, 0.95, 8.0, 0.7, None, None),
        (2, 0, False, 100, 0.95, 8.0, 0.8, 50, 60), (2, 1, False, 100, 0.9, 8.0, 0.8, 80, 20)],
        "page int, index int, uses_dpi boolean, count int, placed double, longest_bar double, quality double, positioned int, unverified int")
    got = {r.page: (r.kept, r.placed) for r in Q.choose_variants(old, variants, ["page"]).collect()}
    assert got == {1: (3, 0.95), 2: (1, 0.9)}


def test_cut_reports(spark):
    cuts = [(1, 0, 500, 100, True), (1, 1, 700, 100, True), (1, 2, 1_000_000, 900_000, False), (1, 3, 0, 0, True), (1, 4, 2_000, 5_000, True), (1, 5, 0, 0, True),
            (2, 0, 3_500, 1_000, False), (2, 1, 0, 0, False), (2, 2, 600, 0, True)]
    df = spark.createDataFrame(cuts, "session_id int, cut int, active_ms long, playing_ms long, sent boolean")
    got = {(r.session_id, r.cut): (r.seconds, r.playing_seconds) for r in U.cut_reports(df).collect()}
    # what a report leaves, or one that was not sent, goes into the next; a report holds 600 seconds at most, and no more playing than seconds
    assert got[1, 0] == (0, 0) and got[1, 1] == (1, 0) and got[1, 2] == (600, 600) and got[1, 3] == (600, 600) and got[1, 4][0] == 2
    assert [got[2, i] for i in range(3)] == [(3, 1), (3, 1), (4, 1)]
    assert all(p <= s <= 600 for s, p in got.values())

def test_tie_roots(spark):
    from quaverlake.operators.resolve import tie_roots
    pairs = spark.createDataFrame([(0, f"h{i}", f"h{i + 1}") for i in range(9)] + [(0, "x", "y"), (0, "z", None)], "p int, left string, right string")
    got = {r.head_id: r.root for r in tie_roots(pairs, ["p"]).collect()}
    assert got == {**{f"h{i + 1}": "h0" for i in range(9)}, "y": "x"}


def test_titles_drop_controls_before_blanks_join(spark):
    from quaverlake.functions import text
    got = spark.createDataFrame([("a \x00 b",), ("  x\t\ny\x7f ",), ("\x01",), (None,), ("a\x1cb",)], "t string").select(text.clean_title(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["a b", "x y", None, None, "a b"]


def test_syllables_may_stand_off_their_sign(spark):
    from quaverlake.functions import pitch
    got = spark.createDataFrame([("# fa", "G"), ("b\tSI?", "B"), ("do", "C"), ("fi", "F")], "t string, o string").select(pitch.from_solfege(F.col("t"), F.col("o")).alias("c")).collect()
    assert [r.c for r in got] == ["F♯", "B♭?", "C", None]


def test_degrees_of_all_spellings():
    from quaverlake.functions import pitch
    got = [[pitch._degree(step, alter) for alter in range(-2, 3)] for step in range(7)]
    assert got[0] == [(6, -1), (6, 0), (0, 0), (0, 1), (1, 0)] and got[3] == [(2, -1), (2, 0), (3, 0), (3, 1), (4, 0)] and got[6] == [(5, 0), (6, -1), (6, 0), (0, 0), (0, 1)]
    assert all((pitch.SEMITONES[d] + a - pitch.SEMITONES[step] - alter + 2) % 12 == 0 for step, row in enumerate(got) for alter, (d, a) in enumerate(row))


def test_a_wedge_keeps_going_over_a_continue_mark(spark):
    wedges = spark.createDataFrame([(0, 0, 1, "1", 0.0, 0, "crescendo"), (0, 0, 1, "1", 2.0, 1, "continue"), (0, 0, 1, "1", 4.0, 2, "stop")],
                                   "d int, part int, staff int, number string, start_beat double, seq int, value string")
    dynamics = spark.createDataFrame([(0, 0, 1, 0.0, 0, 60.0)], "d int, part int, staff int, start_beat double, seq int, value double")
    notes = spark.createDataFrame([(0, 0, 1, f"n{i}", float(i)) for i in range(5)], "d int, part int, staff int, source_id string, start_beat double")
    got = {r.source_id: r.value for r in P.ramps(wedges, dynamics, notes, ["d"]).collect()}
    assert got == {"n0": 60.0, "n1": 64.0, "n2": 68.0, "n3": 72.0}


def _ramped(wedges, dynamics, notes):
    """The rule as a loop over stops: samples come after all printed dynamics, in the order in which wedges end."""
    printed, samples, waiting, out = sorted(dynamics), [], {}, {}
    for beat, seq, number, kind in sorted(wedges):
        if kind != "stop":
            waiting[number] = (beat, kind)
        elif number in waiting:
            start, what = waiting.pop(number)
            level = ([80.0] + [v for at, _, v in printed if at <= start] + [v for at, v in samples if at <= start])[-1]
            goal = next((v for at, _, v in printed if abs(at - beat) < 1e-6), level + (16 if what == "crescendo" else -16))
            for n in sorted(notes):
                if start <= n < beat:
                    value = level + (goal - level) * (n - start) / (beat - start)
                    samples.append((n, value))
                    out.setdefault((n, round(value, 6)), 0)
                    out[n, round(value, 6)] += 1
    return out


def test_later_wedges_start_from_what_earlier_ones_reached(spark):
    r = random.Random(5)
    docs = []
    for d in range(40):
        wedges = [(r.randrange(60) / 2, i, r.choice("12"), r.choice(["crescendo", "diminuendo", "stop", "stop"])) for i in range(r.choice([2, 5, 40]))]
        dynamics = [(r.randrange(60) / 2, i, float(r.randrange(30, 110))) for i in range(r.choice([0, 2, 9]))]
        docs.append((wedges, dynamics, [r.randrange(60) / 2 for _ in range(r.choice([4, 25]))]))
    w = [(d, 0, 1, n, at, i, k) for d, (ws, _, _) in enumerate(docs) for at, i, n, k in ws]
    m = [(d, 0, 1, at, i, v) for d, (_, ds, _) in enumerate(docs) for at, i, v in ds]
    n = [(d, 0, 1, f"n{i}", at) for d, (_, _, ns) in enumerate(docs) for i, at in enumerate(ns)]
    frames = (spark.createDataFrame(w, "d int, part int, staff int, number string, start_beat double, seq int, value string"),
              spark.createDataFrame(m, "d int, part int, staff int, start_beat double, seq int, value double"),
              spark.createDataFrame(n, "d int, part int, staff int, source_id string, start_beat double"))
    for width in (None, 4.0):
        got = {}
        for row in P.ramps(*frames, ["d"], width).collect():
            key = (row.d, row.start_beat, round(row.value, 6))
            got[key] = got.get(key, 0) + 1
        assert got == {(d, *k): c for d, doc in enumerate(docs) for k, c in _ramped(*doc).items()}


def test_pedal_is_lifted_after_the_jump_restores_it(spark):
    order = spark.createDataFrame([(0, i, m, 4.0 * i) for i, m in enumerate([0, 1, 0])], "d int, position long, measure_index long, start_beat double")
    events = spark.createDataFrame([(0, 0, 0.0, 0, "pedal", 0, 1, "start")], "d int, measure_index long, beat double, seq int, kind string, part long, staff long, value string")
    staves = spark.createDataFrame([(0, 0, 1)], "d int, part long, staff long")
    got = P.state_at_jumps(order, events.withColumn("measure_index", F.lit(0).cast("long")), staves, ["d"]).collect()
    assert {r.position for r in got if r.rank < 3} == {2}  # the first bar is no jump
    again = P.state_at_jumps(order.withColumn("measure_index", F.col("measure_index") + 1), events, staves, ["d"]).collect()
    assert [(r.value, r.rank) for r in sorted(again, key=lambda r: (r.position, r.rank)) if r.kind == "pedal" and r.position == 2] == [("start", 1), ("stop", 2)]


def test_strikes_keep_their_own_start(spark):
    notes = spark.createDataFrame([(0, 0, 60, 1.0000001, 1.0, 70, "1", "a"), (0, 0, 60, 1.0000002, 2.0, 60, "2", "b")],
                                  "d int, part int, midi int, start_beat double, key_duration double, velocity int, voice string, source_id string")
    r = P.collapse_strikes(notes, ["d"]).first()
    assert (r.start_beat, r.duration, r.velocity, r.source_id, r.strikes) == (1.0000001, 2.0, 70, "a", 2)


@pytest.mark.parametrize("width", [None, 1.0])
def test_each_note_is_in_one_sounding_event(spark, width):
    def note(name, voice, midi, start, length, ties="", grace=False):
        return (0, 1, voice, 1, 1, midi, float(start), length, length, 70 + voice, "start" in ties, "stop" in ties, grace, name)
    notes = spark.createDataFrame(
        [note("a", 1, 57, 0, .25), note("b", 2, 57, 0, .5), note("c", 2, 59, 0, .5),  # one key, two voices
         note("d", 1, 60, 1, 1.0, "start"), note("e", 1, 60, 2, 1.0, "start stop"), note("f", 1, 60, 3, .5, "stop"), note("g", 2, 60, 1, .25),
         note("h", 1, 62, 4, 1.0, "stop"), note("i", 1, 64, 5, .25, grace=True), note("j", 2, 64, 5, 1.0)],
        "d int, part int, voice int, staff int, role int, midi int, start_beat double, duration double, key_duration double, velocity int, tie_start boolean, tie_stop boolean, is_grace boolean, source_id string")
    events = P.sounding_events(notes, ["d"], width)
    got = sorted((r.source_id, r.start_beat, r.duration, r.velocity, r.orphan_stop, "".join(r.segment_ids)) for r in events.collect())
    assert got == [("a", 0.0, 0.5, 72, False, "ab"), ("c", 0.0, 0.5, 72, False, "c"), ("d", 1.0, 2.5, 71, False, "def"), ("g", 1.0, 0.25, 72, False, "g"),
                   ("h", 4.0, 1.0, 71, True, "h"), ("i", 5.0, 0.25, 71, False, "i"), ("j", 5.0, 1.0, 72, False, "j")]
    moved = notes.withColumns({"corrected": F.col("source_id") == "e", "midi": F.when(F.col("source_id") == "e", 61).otherwise(F.col("midi")),
                               "start_beat": F.when(F.col("source_id") == "e", 2.25).otherwise(F.col("start_beat"))})
    audio = events.withColumnRenamed("source_id", "audio_id").withColumn("duration", F.when(F.col("audio_id") == "a", 3.0).otherwise(F.col("duration")))
    out = {r.audio_id: (r.midi, r.start_beat, r.duration) for r in P.correct_audio(audio, moved, notes, ["d"]).collect()}
    assert out["d"] == (61, 1.0, 2.5) and out["a"] == (57, 0.0, 3.0) and out["c"] == (59, 0.0, 0.5) and len(out) == 7


@pytest.mark.parametrize("width", [None, 5.0])
@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_covering_sum_equals_all_pairs(spark, rng, width, kind):
    number = int if kind == "bigint" else (lambda x: x / 8)
    points = [(rng.choice("pq"), i, rng.choice([None, *map(float, range(30))]), "kept") for i in range(120)] + [("p", 1, 4.0, "kept")] * 2
    spans = [(rng.choice("pqr"), a, a + rng.randrange(-2, 12), rng.choice([None, *map(number, range(-5, 9))])) for a in (float(rng.randrange(30)) for _ in range(150))]
    spans += [("p", 0.0, 29.0, number(3))] * 40  # a third of them on one stretch
    got = G.covering_sum(spark.createDataFrame(points, "page string, id int, x double, note string"), spark.createDataFrame(spans, f"page string, left double, right double, amount {kind}"), ["page"], chunk_width=width)
    want = [(*p, number(0) + sum(a or 0 for g, l, r, a in spans if g == p[0] and p[2] is not None and l <= p[2] <= r)) for p in points]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, ((g, i, None if x is None else float(x), n, s) for g, i, x, n, s in want)))
