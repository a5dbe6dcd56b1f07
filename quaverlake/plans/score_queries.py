"""Registered queries of the written score, alignment and the performed timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaverlake.functions import marks as M
from quaverlake.operators import align as A
from quaverlake.operators import performed as P
from quaverlake.operators import resolve as R
from quaverlake.operators import segments as X
from quaverlake.operators import written as W
from quaverlake.operators.asof import asof_join
from quaverlake.plans.page_queries import heads
from quaverlake.plans.registry import query
from quaverlake.plans.sql_bindings import define, with_ctes
from quaverlake.sources import bindings as B

DOC = ["doc_id"]
BAR = ["doc_id", "measure"]

# --- bindings --------------------------------------------------------------------------------------

define("bars", """
    SELECT o_orderkey // 64 AS doc_id, o_orderkey % 64 AS measure_index, coalesce(c, 4.0) AS content, coalesce(pk, 1) AS pk, coalesce(sk, 2) AS sk,
           CASE WHEN coalesce(sk, 2) % 3 = 0 THEN coalesce(c, 4.0) ELSE 24.0 END AS nominal, coalesce(pk, 1) % 17 = 0 AS implicit,
           CAST(o_orderkey % 64 + 1 AS VARCHAR) AS label, o_orderkey % 64 // 16 AS page, o_orderkey % 16 // 4 AS system, o_orderkey % 4 AS slot
    FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) / 4 AS c, max(l_partkey) AS pk, max(l_suppkey) AS sk FROM lineitem GROUP BY 1)
         ON l_orderkey = o_orderkey""")


def bars(spark, d):
    li = (B.table(spark, d, "lineitem").groupBy("l_orderkey")
          .agg((F.sum("l_quantity") / 4).alias("c"), F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s")))
    o = B.table(spark, d, "orders").select("o_orderkey")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    j = j.withColumns({"content": F.coalesce("c", F.lit(4.0)), "pk": F.coalesce("p", F.lit(1)), "sk": F.coalesce("s", F.lit(2))})
    return j.select(F.floor(k / 64).cast("bigint").alias("doc_id"), (k % 64).alias("measure_index"), "content", "pk", "sk",
                    F.when(F.col("sk") % 3 == 0, F.col("content")).otherwise(24.0).alias("nominal"), (F.col("pk") % 17 == 0).alias("implicit"),
                    (k % 64 + 1).cast("string").alias("label"), F.floor(k % 64 / 16).cast("bigint").alias("page"),
                    F.floor(k % 16 / 4).cast("bigint").alias("system"), (k % 4).alias("slot"))


def _chunk():
    return X.chunk_of("measure_index", 16)

define("timed", """
    SELECT doc_id, slot, 0 AS part, staff, voice, lpad(CAST(slot AS VARCHAR), 6, '0') AS source_id, 60 + midi % 4 AS midi, CAST(slot // 2 * 0.5 AS DOUBLE) AS start_beat,
           CAST(0.5 * (1 + part_key % 3) AS DOUBLE) AS duration, flag = 'A' AS tie_start, flag = 'R' AS tie_stop, discount >= 0.09 AS is_grace, tax, part_key, supp_key,
           line_number, flag, measure FROM notes""", "notes")


def timed(spark, d):
    n = B.score_notes(spark, d)
    arts = (F.when(F.col("tax") < 0.005, F.array(F.lit("staccato"))).when(F.col("tax") < 0.015, F.array(F.lit("accent")))
            .when(F.col("tax") < 0.025, F.array(F.lit("strong-accent"), F.lit("staccatissimo"))).otherwise(F.array().cast("array<string>")))
    return n.select("doc_id", "slot", F.lit(0).cast("bigint").alias("part"), "staff", "voice", F.lpad(F.col("slot").cast("string"), 6, "0").alias("source_id"),
                    (60 + F.col("midi") % 4).alias("midi"), (F.floor(F.col("slot") / 2) * 0.5).alias("start_beat"),
                    (0.5 * (1 + F.col("part_key") % 3)).alias("duration"), (F.col("flag") == "A").alias("tie_start"), (F.col("flag") == "R").alias("tie_stop"),
                    (F.col("discount") >= 0.09).alias("is_grace"), arts.alias("articulations"), "tax", "part_key", "supp_key", "line_number", "flag", "measure")


def marked(spark, d, *line_numbers):
    """Some lines of an order as expression marks."""
    return timed(spark, d).filter(F.col("line_number").isin(*line_numbers))


def _width(spark, d):
    """The beats by which notes are cut into chunks, if an order has so many lines that one task should not scan them."""
    return X.for_long(B.table(spark, d, "lineitem"), ["l_orderkey"], 64.0)


_ART = "CASE WHEN tax < 0.005 THEN 0 WHEN tax < 0.015 THEN 10 WHEN tax < 0.025 THEN 18 ELSE 0 END"
_FACTOR = "CASE WHEN tie_start THEN 1.0 WHEN tax < 0.005 THEN 0.5 WHEN tax >= 0.015 AND tax < 0.025 THEN 0.25 ELSE 1.0 END"

# --- as-of, clefs, accidentals ----------------------------------------------------------------------


@query("J09_asof_join", """
    SELECT e.event_id, coalesce((SELECT max({'at': p.ts, 'id': p.event_id, 'value': p.value}).value FROM events p
           WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts), -1.0) AS last_purchase
    FROM events e WHERE event_type <> 'purchase'""")
def _(spark, d):
    e = B.table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.filter(F.col("event_type") != "purchase").select("user_id", "at", "event_id")
    right = e.filter(F.col("event_type") == "purchase").select("user_id", "at", F.col("event_id").alias("seq"), F.col("value").alias("last_purchase"))
    out = asof_join(left, right, ["user_id"], "at", ["last_purchase"], "seq", {"last_purchase": -1.0}, 86400e6)
    return out.select("event_id", "last_purchase")


_CLEF = "CASE WHEN part_key % 2 = 0 THEN 'G' ELSE 'C' END"


@query("J10_effective_clef_key", with_ctes("notes") + f"""
    , lastof AS (SELECT doc_id, measure, staff, last({_CLEF} ORDER BY slot) FILTER (line_number <= 2) AS lc,
                        last(part_key % 9 - 4 ORDER BY slot) FILTER (line_number = 3) AS lk FROM notes GROUP BY 1, 2, 3),
    home AS (SELECT *, coalesce(last_value(lc IGNORE NULLS) OVER w, CASE WHEN staff = 1 THEN 'G' ELSE 'F' END) AS dc,
                    coalesce(last_value(lk IGNORE NULLS) OVER w, 0) AS dk
             FROM lastof WINDOW w AS (PARTITION BY doc_id, staff ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    at AS (SELECT *, last_value(CASE WHEN line_number <= 2 THEN {_CLEF} END IGNORE NULLS) OVER w AS omr,
                  last_value(CASE WHEN line_number = 4 THEN 'F' END IGNORE NULLS) OVER w AS pdf,
                  last_value(CASE WHEN line_number = 3 THEN part_key % 9 - 4 END IGNORE NULLS) OVER w AS k
           FROM notes WINDOW w AS (PARTITION BY doc_id, measure, staff ORDER BY slot))
    SELECT n.doc_id, n.slot, coalesce(pdf, omr, dc) AS clef, coalesce(omr, dc) AS recognized_clef, CASE WHEN pdf IS NULL THEN 'omr' ELSE 'pdf' END AS clef_source,
           coalesce(k, dk) AS key_fifths FROM ats n JOIN home h ON h.doc_id = n.doc_id AND h.measure = n.measure AND h.staff = n.staff
    """.replace("\n    , lastof", ", lastof").replace("    at AS", "    ats AS"))
def _(spark, d):
    n = B.score_notes(spark, d).withColumn("page", F.col("measure"))
    at = ["doc_id", "page", "staff", F.col("slot").cast("double").alias("x"), F.col("slot").alias("seq")]
    clefs = n.filter(F.col("line_number") <= 2).select(*at, F.when(F.col("part_key") % 2 == 0, "G").otherwise("C").alias("value"))
    pdf = n.filter(F.col("line_number") == 4).select(*at, F.lit("F").alias("value"))
    keys = n.filter(F.col("line_number") == 3).select(*at, (F.col("part_key") % 9 - 4).alias("value"))
    staves = n.select("doc_id", "page", "staff").distinct().withColumn("role", F.col("staff") - 1).withColumn("staff_order", F.col("staff"))
    hs = n.select("doc_id", "page", "staff", "slot", F.col("slot").cast("double").alias("x"))
    out = R.effective_clef_key(hs, clefs, pdf, keys, staves, DOC)
    return out.select("doc_id", "slot", "clef", "recognized_clef", "clef_source", "key_fifths")


def _edges(spark, d):
    n = B.score_notes(spark, d)
    kind = F.when(F.col("line_number") <= 2, "slur-head").when(F.col("line_number") == 3, "alter-head").otherwise("containment")
    return n.select("doc_id", kind.alias("kind"), (F.col("part_key") % 3).cast("string").alias("source"), F.col("slot").cast("string").alias("target"),
                    F.when(F.col("supp_key") % 2 == 0, "LEFT").otherwise("RIGHT").alias("side"), F.col("slot").alias("seq"))


@query("J21_relations", with_ctes("notes") + """
    SELECT doc_id, CAST(part_key % 3 AS VARCHAR) AS source, 'tie' AS kind,
           CAST(max(slot) FILTER (supp_key % 2 = 0) AS VARCHAR) AS a, CAST(max(slot) FILTER (supp_key % 2 <> 0) AS VARCHAR) AS b
    FROM notes WHERE line_number <= 2 AND part_key % 3 <> 2 GROUP BY 1, 2
    UNION ALL SELECT doc_id, CAST(slot AS VARCHAR), 'alter', CASE part_key % 3 WHEN 0 THEN 'FLAT' ELSE 'SHARP' END, NULL FROM notes
    WHERE line_number = 3 AND part_key % 3 <> 2
    UNION ALL SELECT doc_id, CAST(slot AS VARCHAR), 'chord', CAST(part_key % 3 AS VARCHAR), NULL FROM notes WHERE line_number > 3 AND part_key % 3 <> 0""")
def _(spark, d):
    e = _edges(spark, d)
    docs = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    slurs = docs.withColumn("slur_id", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2")))).withColumn("tie", F.col("slur_id") != "2")
    alters = docs.withColumn("alter_id", F.explode(F.array(F.lit("0"), F.lit("1")))).withColumn(
        "shape", F.when(F.col("alter_id") == "0", "FLAT").otherwise("SHARP"))
    chords = docs.withColumn("chord_id", F.explode(F.array(F.lit("1"), F.lit("2"))))
    none = F.lit(None).cast("string")
    return (R.tie_pairs(e, slurs, DOC).select("doc_id", "source", F.lit("tie").alias("kind"), F.col("left").alias("a"), F.col("right").alias("b"))
            .unionByName(R.alter_map(e, alters, DOC).select("doc_id", F.col("head_id").alias("source"), F.lit("alter").alias("kind"), F.col("shape").alias("a"), none.alias("b")))
            .unionByName(R.chord_map(e, chords, DOC).select("doc_id", F.col("head_id").alias("source"), F.lit("chord").alias("kind"), F.col("chord_id").alias("a"), none.alias("b"))))


@query("J38_chord_onsets", with_ctes("notes") + """
    , st AS (SELECT doc_id, measure, row_number() OVER (PARTITION BY doc_id ORDER BY measure) - 1 AS slot,
             CASE WHEN min(part_key) % 3 = 0 THEN 'X' ELSE '' END || CAST(measure % 2 AS VARCHAR) AS label
             FROM notes GROUP BY doc_id, measure HAVING min(part_key) % 7 <> 0),
    sn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY measure) AS nth FROM st),
    ms AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY measure) AS nth FROM (
             SELECT doc_id, measure, CASE WHEN min(part_key) % 3 = 0 THEN 'X' ELSE '' END || CAST(measure % 2 AS VARCHAR) AS label FROM notes GROUP BY 1, 2))
    SELECT n.doc_id, 0 AS system, 0 AS part, ms.label AS measure_id, sn.slot, CAST(n.slot AS VARCHAR) AS chord_id,
           CASE WHEN n.supp_key % 4 <> 0 THEN n.voice END AS voice,
           CASE WHEN n.supp_key % 4 <> 0 AND n.tax < 0.07 THEN (n.slot % 4) / 4.0 * 4 END AS onset
    FROM notes n JOIN ms ON ms.doc_id = n.doc_id AND ms.measure = n.measure
    JOIN sn ON sn.doc_id = ms.doc_id AND sn.label = ms.label AND sn.nth = ms.nth""".replace("\n    , st", ", st"))
def _(spark, d):
    n = B.score_notes(spark, d)
    per = n.groupBy("doc_id", "measure").agg(F.min("part_key").alias("p"), F.sort_array(F.collect_list(F.col("slot").cast("string"))).alias("chord_ids"))
    zero = F.lit(0).cast("int").alias("system")
    stacks = per.select("doc_id", zero, F.col("measure").alias("stack_seq"), (F.col("measure") % 2).cast("string").alias("stack_id"),
                        F.when(F.col("p") % 7 == 0, "CAUTIONARY").when(F.col("p") % 3 == 0, "SECOND_HALF").alias("special"))
    name = F.concat(F.when(F.col("p") % 3 == 0, "X").otherwise(""), (F.col("measure") % 2).cast("string"))
    ms = per.select("doc_id", zero, F.lit(0).alias("part"), F.col("measure").alias("measure_seq"), name.alias("measure_id"), "chord_ids")
    ent = n.select("doc_id", zero, F.lit(0).alias("part"), F.col("measure").alias("measure_seq"), F.col("slot").cast("string").alias("chord_id"), "voice",
                   (F.col("slot") % 4).alias("slot_id"), F.when(F.col("supp_key") % 4 == 0, "CONTINUE").otherwise("BEGIN").alias("status"), "tax")
    # A slot without an offset leaves its chords unplaced.
    ent = ent.withColumn("slot_id", F.when(F.col("tax") < 0.07, F.col("slot_id"))).drop("tax")
    # Every stack has four slots; the offsets are the stack's, whichever measure is placed there.
    grid = per.select("doc_id", F.col("measure").alias("stack_seq"), F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("slot_id"))
    slots = grid.withColumn("offset", F.concat(F.col("slot_id").cast("string"), F.lit("/4")))
    return R.chord_onsets(stacks, slots, ms, ent, DOC)


@query("W03_carry_marks", with_ctes("heads") + """
    , h AS (SELECT *, CASE shape WHEN 'SHARP' THEN 1 WHEN 'NATURAL' THEN 0 END AS e, coalesce(onset, seq % 4 + 10.0) AS t, pitch % 3 AS dia, doc_id % 3 - 1 AS k FROM heads),
    b AS (SELECT doc_id, measure, staff, dia, t, min(e) AS lo, max(e) AS hi FROM h GROUP BY ALL),
    m AS (SELECT *, CASE WHEN lo = hi THEN lo WHEN lo < hi THEN 99 END AS mark FROM b),
    c AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id, measure, staff, dia ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
                 max(mark) OVER (PARTITION BY doc_id, measure, staff, t) = 99 AS clash FROM m)
    SELECT h.head_id, CAST(coalesce(e, CASE WHEN mark <> 99 THEN mark END, CASE WHEN before <> 99 THEN before END, k) AS BIGINT) AS alter,
           CASE WHEN mark <> 99 THEN false WHEN coalesce(clash, false) THEN true ELSE coalesce(before = 99, false) END AS pitch_uncertain
    FROM h JOIN c ON h.doc_id = c.doc_id AND h.measure = c.measure AND h.staff = c.staff AND h.dia = c.dia AND h.t = c.t""".replace("\n    , h", ", h"))
def _(spark, d):
    h = heads(spark, d).select("doc_id", "measure", "staff", "head_id", F.coalesce("onset", F.col("seq") % 4 + 10.0).alias("onset"),
                               (F.col("pitch") % 3).alias("diatonic"), F.when(F.col("shape") == "SHARP", 1).when(F.col("shape") == "NATURAL", 0).alias("explicit"),
                               (F.col("doc_id") % 3 - 1).alias("key_alter"))
    return R.carry_marks(h, ["doc_id", "measure", "staff"]).select("head_id", F.col("alter").cast("bigint").alias("alter"), "pitch_uncertain")


# --- written score -----------------------------------------------------------------------------------

_EL = """el AS (SELECT doc_id, measure, slot, CASE part_key % 6 WHEN 0 THEN 'backup' WHEN 1 THEN 'forward' ELSE 'note' END AS kind,
      part_key % 6 > 1 AND part_key % 5 = 0 AS chord, part_key % 6 > 1 AND discount >= 0.09 AS grace,
      duration / coalesce(last_value(CASE WHEN line_number % 3 = 0 THEN 1 + supp_key % 4 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY slot), 1) AS len FROM notes),
    st AS (SELECT *, CASE WHEN kind = 'note' AND NOT chord AND NOT grace THEN len WHEN kind = 'forward' THEN len WHEN kind = 'backup' THEN -len ELSE 0 END AS step FROM el)"""


@query("W06_cursor", with_ctes("notes").replace("WITH", "WITH RECURSIVE", 1).rstrip() + ", " + _EL + """,
    walk AS (SELECT doc_id, measure, slot, kind, chord, len, CAST(0 AS DOUBLE) AS at, greatest(0, step) AS after, kind = 'backup' AND step < -1e-7 AS clamped,
                    CASE WHEN kind = 'note' AND NOT chord THEN CAST(0 AS DOUBLE) END AS lead FROM st WHERE slot % 4 = 0
      UNION ALL SELECT s.doc_id, s.measure, s.slot, s.kind, s.chord, s.len, w.after, greatest(0, w.after + s.step), s.kind = 'backup' AND w.after + s.step < -1e-7,
                    CASE WHEN s.kind = 'note' AND NOT s.chord THEN w.after ELSE w.lead END
      FROM walk w JOIN st s ON s.doc_id = w.doc_id AND s.measure = w.measure AND s.slot = w.slot + 1)
    SELECT doc_id, slot, CASE WHEN kind = 'note' THEN round(lead, 6) END AS start, round(len, 6) AS length, clamped FROM walk""")
def _(spark, d):
    n = B.score_notes(spark, d)
    kind = F.when(F.col("part_key") % 6 == 0, "backup").when(F.col("part_key") % 6 == 1, "forward").otherwise("note")
    el = n.select("doc_id", F.col("measure").alias("measure_seq"), F.col("slot").alias("seq"), kind.alias("kind"), "duration",
                  F.when(F.col("line_number") % 3 == 0, 1 + F.col("supp_key") % 4).alias("divisions"),
                  ((F.col("part_key") % 6 > 1) & (F.col("part_key") % 5 == 0)).alias("chord"),
                  ((F.col("part_key") % 6 > 1) & (F.col("discount") >= 0.09)).alias("grace"))
    out = W.cursor(el, DOC, chunk=X.chunk_of("measure_seq", 64))
    return out.select("doc_id", F.col("seq").alias("slot"), F.when(F.col("kind") == "note", F.round("start", 6)).alias("start"),
                      F.round("length", 6).alias("length"), "clamped")


@query("W07_layout_counters", with_ctes("bars").replace("WITH", "WITH RECURSIVE", 1) + """
    , b AS (SELECT *, pk % 13 = 0 AS np, pk % 4 = 0 AS ns, CASE WHEN pk % 26 = 0 THEN pk % 50 END AS num, CASE WHEN pk % 9 = 0 THEN 2 + sk % 3 ELSE 0 END AS rb,
                   CAST(sk % 7 AS VARCHAR) AS lab FROM bars),
    walk AS (SELECT doc_id, measure_index, CASE WHEN num IS NOT NULL THEN num WHEN np THEN 2 ELSE 1 END AS page,
                    CASE WHEN ns AND NOT np THEN 1 ELSE 0 END AS system, CAST(0 AS BIGINT) AS slot, CASE WHEN rb >= 1 THEN rb - 1 ELSE 0 END AS left_, false AS cont
      FROM b WHERE measure_index = 0
      UNION ALL SELECT doc_id, measure_index, page, system,
                       CASE WHEN cont THEN oslot WHEN fresh THEN 0 ELSE oslot + 1 END,
                       CASE WHEN rb >= 1 THEN rb - 1 WHEN cont THEN oleft - 1 ELSE 0 END, cont FROM (
        SELECT b.doc_id, b.measure_index, b.rb, w.slot AS oslot, w.left_ AS oleft, b.np OR b.ns AS fresh, w.left_ > 0 AND NOT (b.np OR b.ns) AS cont,
               CASE WHEN b.np AND b.num IS NOT NULL THEN b.num WHEN b.np THEN w.page + 1 ELSE w.page END AS page,
               CASE WHEN b.np THEN 0 WHEN b.ns THEN w.system + 1 ELSE w.system END AS system
        FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.measure_index = w.measure_index + 1))
    SELECT w.doc_id, w.measure_index, CAST(w.page AS BIGINT) AS page, CAST(w.system AS BIGINT) AS system, w.slot, w.cont AS rest_continuation,
           row_number() OVER (PARTITION BY w.doc_id, lab ORDER BY w.measure_index) - 1 AS occurrence
    FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.measure_index = w.measure_index""".replace("\n    , b", ", b"))
def _(spark, d):
    b = bars(spark, d)
    m = b.select("doc_id", F.col("measure_index"), (F.col("sk") % 7).cast("string").alias("label"), (F.col("pk") % 13 == 0).alias("new_page"),
                 (F.col("pk") % 4 == 0).alias("new_system"), F.when(F.col("pk") % 26 == 0, F.col("pk") % 50).alias("page_number"),
                 F.when(F.col("pk") % 9 == 0, 2 + F.col("sk") % 3).otherwise(0).alias("rest_bars"))
    out = W.layout_counters(m, DOC, "measure_index", _chunk())
    return out.select("doc_id", "measure_index", "page", "system", "slot", "rest_continuation", "occurrence")


@query("A37_merge_parts", with_ctes("notes") + """
    , m AS (SELECT doc_id, staff AS part, CAST(measure AS VARCHAR) AS label, measure AS measure_index, sum(duration) AS content, max(duration) AS nominal,
            max(supp_key) AS sk, max(part_key) AS pk, min(tax) >= 0.06 AS implicit FROM notes GROUP BY 1, 2, 4),
    z AS (SELECT *, count(*) OVER (PARTITION BY doc_id, part) AS len FROM m)
    SELECT doc_id, label, first(sk % 3 ORDER BY len DESC, part) AS page, first(sk % 4 ORDER BY len DESC, part) AS system, first(sk % 5 ORDER BY len DESC, part) AS slot,
           first(implicit ORDER BY len DESC, part) AS implicit, max(nominal) AS nominal, max(content) AS content, max(pk % 4) AS repeat_backward,
           bool_or(pk % 5 = 0) AS repeat_forward, array_to_string(list_sort(list_distinct(list(pk % 2) || list(1))), ',') AS endings FROM z GROUP BY 1, 2"""
       .replace("\n    , m", ", m"))
def _(spark, d):
    m = B.score_notes(spark, d).groupBy("doc_id", F.col("staff").alias("part"), F.col("measure").alias("measure_index")).agg(
        F.sum("duration").alias("content"), F.max("duration").alias("nominal"), F.max("supp_key").alias("sk"), F.max("part_key").alias("pk"),
        (F.min("tax") >= 0.06).alias("implicit"))
    rows = m.select("doc_id", "part", "measure_index", F.col("measure_index").cast("string").alias("label"), F.lit(0).alias("occurrence"),
                    (F.col("sk") % 3).alias("page"), (F.col("sk") % 4).alias("system"), (F.col("sk") % 5).alias("slot"), "implicit", "nominal", "content",
                    (F.col("pk") % 4).alias("repeat_backward"), (F.col("pk") % 5 == 0).alias("repeat_forward"),
                    F.array(F.col("pk") % 2, F.lit(1)).alias("endings"), F.array("sk").alias("events"))
    out = W.merge_parts(rows, DOC)
    return out.select("doc_id", "label", "page", "system", "slot", "implicit", "nominal", "content", "repeat_backward", "repeat_forward",
                      F.array_join(F.transform("endings", lambda x: x.cast("string")), ",").alias("endings"))


@query("A38_measure_lengths", with_ctes("bars") + f"""
    SELECT doc_id, measure_index, CASE WHEN irr OR pick THEN content ELSE greatest(nominal, content) END AS length,
           CASE WHEN nominal <> 0 AND abs(content - nominal) > 1e-7 AND NOT irr THEN CASE WHEN pick THEN '{W.PICKUP}' ELSE '{W.DIFFERS}' END ELSE '' END AS warnings
    FROM (SELECT *, implicit OR nominal = 0 OR starts_with(label, 'X') AS irr, measure_index = 0 AND content > 0 AND content < nominal AS pick FROM bars)""")
def _(spark, d):
    return W.measure_lengths(bars(spark, d), DOC).select("doc_id", "measure_index", "length", F.array_join("warnings", "|").alias("warnings"))


@query("A32_meter_confirmed", with_ctes("bars") + """
    SELECT doc_id, page, count(*) FILTER (reg) AS bars, count(*) FILTER (reg AND abs(content - nominal) <= 1e-6) AS fitting,
           count(*) FILTER (reg) >= 4 AND count(*) FILTER (reg AND abs(content - nominal) <= 1e-6) >= 0.8 * count(*) FILTER (reg) AS confirmed
    FROM (SELECT *, NOT implicit AND nominal <> 0 AS reg FROM bars) GROUP BY 1, 2""")
def _(spark, d):
    return W.meter_confirmed(bars(spark, d), ["doc_id", "page"])


@query("W26_carry_endings", with_ctes("bars").replace("WITH", "WITH RECURSIVE", 1) + """
    , b AS (SELECT *, CASE WHEN pk % 5 = 0 THEN CAST(1 + sk % 2 AS VARCHAR) END AS es, CASE WHEN pk % 5 = 2 THEN '9' END AS ee FROM bars),
    walk AS (SELECT doc_id, measure_index, coalesce(es, ee, '') AS endings, CASE WHEN ee IS NOT NULL THEN '' ELSE coalesce(es, '') END AS act FROM b WHERE measure_index = 0
      UNION ALL SELECT b.doc_id, b.measure_index, coalesce(es, nullif(w.act, ''), ee, ''), CASE WHEN ee IS NOT NULL THEN '' ELSE coalesce(es, w.act) END
      FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.measure_index = w.measure_index + 1)
    SELECT doc_id, measure_index, endings FROM walk""".replace("\n    , b", ", b"))
def _(spark, d):
    m = bars(spark, d).select("doc_id", "measure_index", F.when(F.col("pk") % 5 == 0, F.array((1 + F.col("sk") % 2).cast("int"))).alias("ending_start"),
                              F.when(F.col("pk") % 5 == 2, F.array(F.lit(9))).alias("ending_stop"))
    return W.carry_endings(m, DOC, chunk=_chunk()).select("doc_id", "measure_index", F.array_join(F.transform("endings", lambda x: x.cast("string")), ",").alias("endings"))


def _repeats(spark, d):
    b = bars(spark, d)
    ends = F.when(F.col("sk") % 5 == 0, F.array(F.lit(1))).when(F.col("sk") % 5 == 1, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    return b.select("doc_id", "measure_index", "content", (F.col("pk") % 11 == 0).alias("repeat_forward"),
                    F.when(F.col("pk") % 7 == 0, 2 + F.col("pk") % 2).otherwise(0).cast("int").alias("repeat_backward"), ends.alias("endings"),
                    (F.col("pk") % 13 == 1).alias("section_start"), (F.col("pk") % 9 == 2).alias("section_end"), (F.col("sk") % 3 == 0).alias("signature"))


_PAIRS = """
    , r AS (SELECT doc_id, measure_index AS i, pk % 11 = 0 AS fwd, CASE WHEN pk % 7 = 0 THEN CAST(2 + pk % 2 AS INTEGER) ELSE 0 END AS times, sk % 5 < 2 AS has, pk % 13 = 1 AS ss, pk % 9 = 2 AS se, sk % 3 = 0 AS sig FROM bars),
    n AS (SELECT *, coalesce(lead(sig) OVER (PARTITION BY doc_id ORDER BY i), false) AS next_sig FROM r),
    walk AS (SELECT doc_id, CAST(-1 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS open, CAST(0 AS BIGINT) AS section, CAST(NULL AS BIGINT) AS first, 0 AS times FROM n GROUP BY doc_id
      UNION ALL SELECT doc_id, i, CASE WHEN times > 0 AND len(open) > 0 THEN open[:-2] ELSE open END,
             CASE WHEN times > 0 OR (se AND NOT next_sig) THEN i + 1 ELSE section END, CASE WHEN times > 0 THEN CASE WHEN len(open) > 0 THEN open[-1] ELSE section END END, times
      FROM (SELECT n.doc_id, n.i, n.times, n.se, n.next_sig, CASE WHEN fwd THEN list_append(w.open, n.i) ELSE w.open END AS open,
                   CASE WHEN has AND n.i = CASE WHEN ss AND NOT sig THEN n.i ELSE w.section END THEN n.i + 1 WHEN ss AND NOT sig THEN n.i ELSE w.section END AS section
            FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.i = w.i + 1)),
    pairs AS (SELECT doc_id, first, i AS last, times FROM walk WHERE times > 0 AND first <= i)"""


@query("W25_repeat_pairs", with_ctes("bars").replace("WITH", "WITH RECURSIVE", 1) + _PAIRS.replace("\n    , r AS", ", r AS") + "SELECT * FROM pairs")
def _(spark, d):
    return W.repeat_pairs(_repeats(spark, d), DOC, chunk_width=8)


@query("W25_expand_repeats", with_ctes("bars").replace("WITH", "WITH RECURSIVE", 1) + _PAIRS.replace("\n    , r AS", ", r AS") + """,
    nest AS (SELECT p.doc_id, n.i, row_number() OVER (PARTITION BY p.doc_id, n.i ORDER BY p.first, p.last DESC) AS k, p.first, p.times FROM pairs p JOIN n ON n.doc_id = p.doc_id AND n.i BETWEEN p.first AND p.last),
    grown AS (SELECT doc_id, i, 0 AS k, CAST([] AS BIGINT[]) AS path FROM n
      UNION ALL SELECT g.doc_id, g.i, g.k + 1, list_concat(g.path, [x.first, t.p]) FROM grown g JOIN nest x ON x.doc_id = g.doc_id AND x.i = g.i AND x.k = g.k + 1 CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (2), (3)) t(p) WHERE t.p <= x.times),
    whole AS (SELECT g.* FROM grown g LEFT JOIN (SELECT doc_id, i, max(k) AS depth FROM nest GROUP BY 1, 2) x ON x.doc_id = g.doc_id AND x.i = g.i WHERE g.k = coalesce(x.depth, 0)),
    told AS (SELECT doc_id, last AS i, times FROM pairs UNION ALL SELECT n.doc_id, n.i, 1 FROM n WHERE (NOT has OR times > 0) AND NOT EXISTS (SELECT 1 FROM nest x WHERE x.doc_id = n.doc_id AND x.i = n.i)),
    passed AS (SELECT w.doc_id, w.i, w.path, CASE WHEN w.k > 0 THEN w.path[-1] ELSE coalesce((SELECT max_by(t.times, t.i) FROM told t WHERE t.doc_id = w.doc_id AND t.i < w.i), 1) END AS pass,
        w.k = 0 AS bare, CASE WHEN sk % 5 = 0 THEN 1 WHEN sk % 5 = 1 THEN 2 END AS ending FROM whole w JOIN bars b ON b.doc_id = w.doc_id AND b.measure_index = w.i)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_append(path, i)) - 1 AS position, i AS measure_index, CAST(pass AS INTEGER) AS pass, bare AND pass = 1 AND ending IS NOT NULL AS orphan_ending
    FROM passed WHERE ending IS NULL OR (bare AND pass = 1) OR ending = pass""")
def _(spark, d):
    out = W.performance_position(W.expand_repeats(_repeats(spark, d), DOC, chunk=_chunk(), chunk_width=8), DOC, chunk=F.floor(F.col("path")[0] / 8).cast("bigint"))
    return out.select("doc_id", "position", "measure_index", "pass", "orphan_ending")


@query("W05_start_beats", with_ctes("bars") + """
    SELECT doc_id, measure_index, round(coalesce(sum(content) OVER (PARTITION BY doc_id ORDER BY measure_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start_beat FROM bars""")
def _(spark, d):
    out = P.start_beats(bars(spark, d), DOC, "measure_index", "content", 16)
    return out.select("doc_id", "measure_index", F.round("start_beat", 6).alias("start_beat"))


@query("W19_expand_rests", with_ctes("bars") + """
    , g AS (SELECT *, CASE WHEN pk % 6 = 0 THEN 1 + sk % 4 END AS gb, CASE WHEN pk % 6 = 0 THEN content / 2 END AS ga, CASE WHEN pk % 5 = 0 THEN 2 ELSE 0 END AS rb FROM bars),
    s AS (SELECT doc_id, page, system, count(*) AS n, bool_or(implicit) AS imp, min(measure_index) AS i,
                 CASE WHEN (page * 4 + system) % 3 <> 2 THEN min(measure_index) + 1 + (page * 4 + system) END AS st FROM g GROUP BY 1, 2, 3),
    t AS (SELECT *, CASE WHEN NOT imp THEN lead(st) OVER (PARTITION BY doc_id ORDER BY i) - st - n END AS told FROM s),
    m AS (SELECT g.*, t.st, CASE WHEN gb IS NOT NULL AND NOT g.implicit THEN coalesce(CASE WHEN told BETWEEN 1 AND 999 THEN told END, CASE WHEN gb >= 2 THEN gb END) END AS bars
          FROM g JOIN t ON t.doc_id = g.doc_id AND t.page = g.page AND t.system = g.system),
    r AS (SELECT doc_id, page, system, measure_index, 0 AS sub, label, st, CASE WHEN bars IS NULL THEN rb ELSE 0 END AS repeat_backward,
                 CASE WHEN bars IS NULL THEN content ELSE ga END AS content, CASE WHEN bars IS NULL THEN greatest(nominal, content) ELSE greatest(nominal, ga) END AS length, bars FROM m
          UNION ALL SELECT doc_id, page, system, measure_index, k, label, st, CASE WHEN k = bars THEN rb ELSE 0 END, 0.0, nominal, bars
          FROM (SELECT *, unnest(range(1, CAST(bars AS INTEGER) + 1)) AS k FROM m WHERE bars IS NOT NULL))
    SELECT doc_id, measure_index, CAST(sub AS INTEGER) AS sub, CAST(repeat_backward AS INTEGER) AS repeat_backward, round(content, 6) AS content, round(length, 6) AS length,
           CASE WHEN any_ AND st IS NOT NULL THEN CAST(st + k - 1 AS VARCHAR) ELSE label END AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, system ORDER BY measure_index, sub) AS k, bool_or(bars IS NOT NULL) OVER (PARTITION BY doc_id) AS any_ FROM r)
    """.replace("\n    , g", ", g"))
def _(spark, d):
    b = bars(spark, d)
    glued = F.col("pk") % 6 == 0
    m = b.select("doc_id", "measure_index", "page", "system", "label", "implicit", "nominal", "content", F.greatest("nominal", "content").alias("length"),
                 F.when(F.col("pk") % 5 == 0, 2).otherwise(0).alias("repeat_backward"), F.when(glued, 1 + F.col("sk") % 4).alias("glued_bars"),
                 F.when(glued, F.col("content") / 2).alias("glued_at"))
    index = F.col("page") * 4 + F.col("system")
    starts = (b.groupBy("doc_id", "page", "system").agg(F.min("measure_index").alias("i")).filter(index % 3 != 2)
              .select("doc_id", "page", "system", (F.col("i") + 1 + index).alias("number")))
    out = W.expand_rests(m, starts, DOC, 999)
    return out.select("doc_id", "measure_index", "sub", "repeat_backward", F.round("content", 6).alias("content"), F.round("length", 6).alias("length"), "label")


_DOUBT = "The printed time signature could not be read confidently and none was recoverable from the PDF; bar lengths here may be wrong."


@query("W24_carry_meter", with_ctes("bars") + f"""
    , c AS (SELECT *, last_value(CASE WHEN pk % 31 = 0 THEN 20.0 + sk % 3 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY measure_index) AS meter,
                   max(CASE WHEN page >= 1 AND doc_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY measure_index) = 1 AS doubt FROM bars),
    f AS (SELECT *, meter IS NOT NULL AND NOT implicit AND abs(nominal - meter) > 1e-6 AS fix FROM c),
    n AS (SELECT *, CASE WHEN fix THEN meter ELSE nominal END AS nom, CASE WHEN fix THEN greatest(meter, content) ELSE greatest(nominal, content) END AS len,
                 count(*) FILTER (doubt AND meter IS NULL) OVER (PARTITION BY doc_id ORDER BY measure_index) AS nth FROM f)
    SELECT doc_id, measure_index, nom AS nominal, len AS length, concat_ws('|',
        CASE WHEN abs(content - nominal) > 1e-7 AND NOT (fix AND abs(content - meter) <= 1e-6) THEN 'Recognized duration differs' END,
        CASE WHEN fix AND doubt THEN 'Time signature corrected from the printed PDF; the recognized one was read with low confidence.'
             WHEN fix THEN 'Time signature corrected from the printed PDF.' END,
        CASE WHEN doubt AND meter IS NULL AND (nth = 1 OR abs(content - nom) > 1e-6) THEN '{_DOUBT}' END) AS warnings FROM n""".replace("\n    , c", ", c"))
def _(spark, d):
    off = F.abs(F.col("content") - F.col("nominal")) > 1e-7
    m = bars(spark, d).withColumns({
        "printed_meter": F.when(F.col("pk") % 31 == 0, 20.0 + F.col("sk") % 3), "doubtful": (F.col("page") >= 1) & (F.col("doc_id") % 2 == 0),
        "length": F.greatest("nominal", "content"), "warnings": F.array_compact(F.array(F.when(off, "Recognized duration differs")))})
    return W.carry_meter(m, DOC, chunk=_chunk()).select("doc_id", "measure_index", "nominal", "length", F.array_join("warnings", "|").alias("warnings"))


@query("F19_parse_marks", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 700 * 3 BETWEEN 10 AND 600 THEN CAST(l_partkey % 700 * 3 AS DOUBLE) END AS bpm,
           CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS octaves, CAST((l_linenumber + 2) * 4.0 / 8 + 3 AS DOUBLE) AS beats FROM lineitem""")
def _(spark, d):
    glyph = chr(0xECA3)
    text = F.concat(F.lit(f"{glyph}. = "), (F.col("l_partkey") % 700).cast("string"))
    octave = F.when(F.col("l_suppkey") % 3 == 0, "8va--").when(F.col("l_suppkey") % 3 == 1, " 15ma").otherwise("dim")
    meter = F.array(F.concat(F.col("l_linenumber").cast("string"), F.lit("+2/8")), F.lit("3/4"))
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.metronome(text)["bpm"].alias("bpm"),
                                                M.octave_label(octave)["amount"].alias("octaves"), M.meter_beats(meter).alias("beats"))


# --- alignment ---------------------------------------------------------------------------------------

@query("J16_match_tiered")
def _(spark, d):
    """A bar has four notes, by its number."""
    h = heads(spark, d)
    hs = h.select("doc_id", "measure", (F.col("staff") - 1).alias("role"), F.col("head_id").alias("source_id"), "onset", "pitch", "voice", F.col("cx").alias("x"))
    n = h.select("doc_id", "measure", (F.col("staff") - 1).alias("role"), F.col("head_id").alias("note_id"), "seq", F.coalesce("onset", F.lit(0.0)).alias("start"),
                 "voice", F.col("onset").isNull().alias("is_grace"), (F.col("pitch") + F.col("midi") % 3 * 7 - 7).alias("written_slot"), (F.col("pitch") - 7).alias("sounding_slot"))
    return A.match_tiered(n, hs, BAR, few=True).select("doc_id", "note_id", "head_id")


@query("J22_map_regions", with_ctes("bars") + f"""
    , m AS (SELECT *, CASE WHEN pk % 40 = 0 THEN 'X' || label WHEN pk % 20 = 1 THEN CAST(CAST(label AS BIGINT) + 1 AS VARCHAR) ELSE label END AS lab,
                   CASE WHEN pk % 10 = 3 THEN greatest(slot - 1, 0) ELSE slot END AS sl FROM bars),
    s AS (SELECT doc_id, page, system, count(DISTINCT sl) AS n, bool_and(regexp_matches(lab, '^[0-9]+$')) AS plain, min(TRY_CAST(lab AS BIGINT)) AS lo, max(TRY_CAST(lab AS BIGINT)) AS hi,
                 coalesce(bool_or(num <= pnum), false) AS back FROM (SELECT *, TRY_CAST(lab AS BIGINT) AS num, lag(TRY_CAST(lab AS BIGINT)) OVER (PARTITION BY doc_id, page, system ORDER BY measure_index) AS pnum FROM m) GROUP BY 1, 2, 3),
    j AS (SELECT m.*, s.n, 4 + (m.doc_id + m.system) % 2 AS r, plain AND NOT back AND hi - lo + 1 = 4 + (m.doc_id + m.system) % 2 AS bynum, lo FROM m JOIN s ON s.doc_id = m.doc_id AND s.page = m.page AND s.system = m.system)
    SELECT doc_id, measure_index, n <> r AS count_mismatch, page || '-' || system || '-' || CASE WHEN n = r THEN sl WHEN bynum THEN CAST(lab AS BIGINT) - lo END AS region_id,
           CASE WHEN n = r THEN NULL WHEN bynum THEN '{A.MISSING_PLACED}' ELSE '{A.MISSING_LEFT}' END AS warning FROM j""".replace("\n    , m", ", m"))
def _(spark, d):
    b = bars(spark, d)
    lab = (F.when(F.col("pk") % 40 == 0, F.concat(F.lit("X"), F.col("label"))).when(F.col("pk") % 20 == 1, (F.col("label").cast("bigint") + 1).cast("string"))
           .otherwise(F.col("label")))
    ms = b.select("doc_id", "page", "system", "measure_index", lab.alias("label"), F.when(F.col("pk") % 10 == 3, F.greatest(F.col("slot") - 1, F.lit(0))).otherwise(F.col("slot")).alias("slot"))
    n = (4 + (F.col("doc_id") + F.col("system")) % 2).cast("int")
    regions = (b.select("doc_id", "page", "system").distinct().withColumn("region_slot", F.explode(F.sequence(F.lit(0), n - 1)))
               .withColumn("region_id", F.concat_ws("-", F.col("page").cast("string"), F.col("system").cast("string"), F.col("region_slot").cast("string"))))
    return A.map_regions(ms, regions, DOC).select("doc_id", "measure_index", "count_mismatch", "region_id", "warning")


@query("J37_system_staff", with_ctes("notes") + """
    SELECT doc_id, slot, CASE WHEN measure % 3 <> 2 AND part_key % 3 <> 2 AND supp_key % 3 + 1 <= 2 THEN part_key % 3 * 2 + supp_key % 3 + 1 ELSE staff END AS system_staff FROM notes""")
def _(spark, d):
    n = B.score_notes(spark, d).withColumns({"part_id": (F.col("part_key") % 3).cast("string"), "part_staff": F.col("supp_key") % 3 + 1})
    roles = F.create_map(F.lit("0"), F.array(F.lit(0), F.lit(1)), F.lit("1"), F.array(F.lit(2), F.lit(3)))
    regions = n.select("doc_id", "measure").distinct().filter(F.col("measure") % 3 != 2).withColumn("part_roles", roles)
    return A.system_staff(n, regions, BAR).select("doc_id", "slot", "system_staff")


@query("P15_resolve_pitch", with_ctes("notes") + f"""
    SELECT doc_id, slot, CAST(hd.midi0 + s * 12 + 1 AS INTEGER) AS midi, hd.dia - s * 7 AS label_diatonic,
           CASE WHEN pdf IS NOT NULL THEN 'pdf-octave' WHEN line_status = 'F' THEN 'pdf-clef' ELSE 'matched-omr' END AS pitch_source,
           CASE WHEN pdf IS NULL AND seen <> supp_key % 2 AND flag <> 'N' THEN '{A.OCTAVE_DISAGREES}' ELSE '' END AS warnings FROM (
      SELECT *, CAST(coalesce(pdf, seen) AS BIGINT) AS s, {{'dia': dia, 'midi0': (4 - CAST(floor(dia / 7) AS BIGINT) + 1) * 12 + [0,2,4,5,7,9,11][CAST(((6 - dia) % 7 + 7) % 7 + 1 AS INTEGER)] + al}} AS hd FROM (
        SELECT *, CASE WHEN (line_status <> 'F' OR part_key % 2 = 0) AND NOT (part_key % 3 - 1 = 0 AND supp_key % 3 - 1 <> 0) THEN supp_key % 3 - 1 ELSE part_key % 3 - 1 END AS al,
               part_key % 20 - 6 AS dia, CASE WHEN part_key % 5 = 0 THEN CAST(1 AS BIGINT) END AS pdf,
               CAST(floor((part_key % 9 - 4 + 0 - (34 - ((3 + supp_key % 3) * 7 + part_key % 7))) / 7) AS BIGINT) AS seen FROM notes))""")
def _(spark, d):
    n = B.score_notes(spark, d)
    letters = F.array(*[F.lit(x) for x in "CDEFGAB"])
    pk, sk = F.col("part_key"), F.col("supp_key")
    pairs = n.select("doc_id", "slot", F.get(letters, (pk % 7).cast("int")).alias("step"), (3 + sk % 3).alias("octave"), (sk % 3 - 1).cast("int").alias("alter"),
                     F.lit(1).alias("transpose"), (sk % 2).alias("octave_shift"), F.lit("G").alias("clef_sign"), F.lit(2).alias("clef_line"), F.lit(0).alias("clef_octave"),
                     (pk % 9 - 4).alias("pitch"), (pk % 20 - 6).alias("diatonic"), (pk % 3 - 1).cast("int").alias("head_alter"), F.lit("G").alias("head_clef"),
                     F.when(pk % 2 == 0, "G").otherwise("F").alias("recognized_clef"), F.when(F.col("line_status") == "F", "pdf").otherwise("omr").alias("clef_source"),
                     F.when(pk % 5 == 0, 1).alias("pdf_octave_shift"), (F.col("flag") == "N").alias("octave_unmarked"))
    return A.resolve_pitch(pairs).select("doc_id", "slot", "midi", "label_diatonic", "pitch_source", F.array_join("warnings", "|").alias("warnings"))


def _score_side(spark, d):
    """Half of the heads as the notes the export kept."""
    h = heads(spark, d)
    return h, h.filter(F.col("seq") % 3 != 0)


@query("J31_restore_deficit", with_ctes("heads") + """
    , n AS (SELECT *, 60 + midi % 4 AS m FROM heads WHERE onset IS NOT NULL AND seq % 3 <> 0),
    h AS (SELECT *, 60 + midi % 4 AS m, row_number() OVER (PARTITION BY doc_id, measure, staff, onset, 60 + midi % 4 ORDER BY cx, head_id) AS r FROM heads WHERE onset IS NOT NULL),
    d AS (SELECT h.doc_id, h.measure, h.staff, h.onset, count(*) - count(*) FILTER (seq % 3 <> 0) AS deficit FROM h GROUP BY ALL),
    k AS (SELECT doc_id, measure, staff, onset, m, count(*) AS c FROM n GROUP BY ALL),
    p AS (SELECT h.*, deficit, row_number() OVER (PARTITION BY h.doc_id, h.measure, h.staff, h.onset ORDER BY CASE WHEN r <= coalesce(c, 0) THEN 1 ELSE 0 END, cx, head_id) AS q
          FROM h JOIN d USING (doc_id, measure, staff, onset) LEFT JOIN k USING (doc_id, measure, staff, onset, m) WHERE part_free)
    SELECT p.doc_id, p.measure, p.staff - 1 AS role, p.head_id AS source_id, p.onset AS start, p.m AS midi, CAST(p.voice AS VARCHAR) AS voice,
           coalesce((SELECT max(n.duration) FROM n WHERE n.doc_id = p.doc_id AND n.measure = p.measure AND n.staff = p.staff AND n.onset = p.onset AND n.voice = p.voice),
             coalesce((SELECT min(h.onset) FROM h WHERE h.doc_id = p.doc_id AND h.measure = p.measure AND h.staff = p.staff AND h.voice = p.voice AND h.onset > p.onset), 4.0) - p.onset) AS duration
    FROM p WHERE q <= deficit""".replace("\n    , n", ", n").replace("WHERE part_free", "WHERE seq % 5 <> 0"))
def _(spark, d):
    h, n = _score_side(spark, d)
    pitch, voice = (60 + F.col("midi") % 4).alias("midi"), F.col("voice").cast("string").alias("voice")
    hs = h.select("doc_id", "measure", (F.col("staff") - 1).alias("role"), F.col("head_id").alias("source_id"), "onset", pitch, voice, "cx", (F.col("seq") % 5 == 0).alias("used"))
    ns = n.filter("onset is not null").select("doc_id", "measure", (F.col("staff") - 1).alias("role"), F.col("onset").alias("start"), pitch, voice, "duration")
    ms = h.select("doc_id", "measure").distinct().withColumn("length", F.lit(4.0))
    return A.restore_deficit(hs, ns, ms, BAR)


@query("J32_infer_from_aligned", with_ctes("heads") + """
    , n AS (SELECT doc_id, measure, staff, cx, coalesce(onset, 0.0) AS start, duration, 60 + midi % 4 AS m FROM heads WHERE seq % 3 <> 0 AND confidence < 0.09),
    x AS (SELECT h.doc_id, h.measure, h.staff, h.head_id, h.cx, 60 + h.midi % 4 AS m, h.seq % 2 = 0 AS whole,
                 min({'s': n.start, 'd': n.duration}) FILTER (n.staff = h.staff) AS own, min(n.start) AS anyst
          FROM heads h JOIN n ON n.doc_id = h.doc_id AND n.measure = h.measure AND n.cx BETWEEN h.cx - greatest(h.w * 2 * 0.6, 1) AND h.cx + greatest(h.w * 2 * 0.6, 1)
          WHERE h.seq % 3 = 0 GROUP BY ALL),
    t AS (SELECT *, coalesce(own.s, CASE WHEN whole THEN anyst END) AS start, coalesce(own.d, CASE WHEN whole THEN 4.0 - anyst END) AS duration FROM x)
    SELECT doc_id, measure, staff - 1 AS role, m AS midi, head_id AS source_id, start, duration, CASE WHEN own IS NULL THEN 'aligned-whole-note' ELSE 'aligned-chord' END AS timing FROM t
    WHERE duration > 1e-6 AND NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = t.doc_id AND n.measure = t.measure AND n.staff = t.staff AND n.m = t.m AND n.start = t.start)
    QUALIFY row_number() OVER (PARTITION BY doc_id, measure, staff, m, start ORDER BY cx, head_id) = 1""".replace("\n    , n", ", n"))
def _(spark, d):
    h, n = _score_side(spark, d)
    pitch = (60 + F.col("midi") % 4).alias("midi")
    hs = h.filter(F.col("seq") % 3 == 0).select("doc_id", "measure", (F.col("staff") - 1).alias("role"), F.col("head_id").alias("source_id"), "cx", (F.col("w") * 2).alias("w"),
                                                F.when(F.col("seq") % 2 == 0, "WHOLE_NOTE").otherwise("NOTEHEAD_BLACK").alias("shape"), pitch)
    ns = n.filter(F.col("confidence") < 0.09).select("doc_id", "measure", (F.col("staff") - 1).alias("role"), "cx", F.coalesce("onset", F.lit(0.0)).alias("start"), "duration", pitch,
                                                     F.lit(False).alias("is_grace"))
    ms = h.select("doc_id", "measure").distinct().withColumn("length", F.lit(4.0))
    return A.infer_from_aligned(hs, ns, ms, BAR)


def _even_heads(spark, d):
    """Bars whose heads stand evenly, one note in four missing from the score."""
    n = B.score_notes(spark, d)
    i = F.col("slot") % 4
    return n.select("doc_id", "measure", F.lit(0).alias("role"), F.col("slot").cast("string").alias("source_id"), (i * 20.0 + F.col("supp_key") % 5).alias("cx"),
                    F.lit(0.9).alias("confidence"), F.lit(False).alias("uncertain"), F.lit("NOTEHEAD_BLACK").alias("shape"), F.lit(True).alias("vector"), i.alias("i"),
                    (F.col("part_key") % 4).alias("p"))


@query("W08_uniform_runs")
def _(spark, d):
    h = _even_heads(spark, d)
    gone = h.groupBy("doc_id", "measure").agg((F.min("p")).alias("gone"), F.count(F.lit(1)).alias("n"))
    j = h.join(gone, BAR)
    kept = j.filter(F.col("i") != F.col("gone")).withColumn("start", F.when(F.col("i") > F.col("gone"), F.col("i") - 1).otherwise(F.col("i")).cast("double"))
    ns = kept.select("doc_id", "measure", "role", F.col("source_id").alias("head_id"), "start", F.lit(1.0).alias("duration"), F.lit("1").alias("voice"), F.lit(False).alias("irregular"))
    ms = gone.select("doc_id", "measure", F.col("n").cast("double").alias("length"))
    return A.uniform_runs(h.drop("i", "p"), ns, ms, h.select("doc_id", "measure", "role").filter(F.col("doc_id") < 0), BAR)


@query("W09_extend_tail")
def _(spark, d):
    h = _even_heads(spark, d)
    size = h.groupBy("doc_id", "measure").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    hs = h.withColumns({"chord_id": none, "onset": F.lit(None).cast("double"), "voice": none, "used": F.col("i") < 3}).drop("vector", "i", "p")
    ns = h.filter(F.col("i") < 3).select("doc_id", "measure", "role", F.col("source_id").alias("head_id"), F.col("i").cast("double").alias("start"), F.lit(1.0).alias("duration"),
                                         F.lit("1").alias("voice"), F.lit(False).alias("irregular"))
    ms = size.select("doc_id", "measure", F.col("n").cast("double").alias("length"))
    rests = h.filter(F.col("p") < 0).select("doc_id", "measure", "role", F.lit(0.0).alias("start"), F.lit(0.0).alias("duration"))
    return A.extend_tail(hs, ns, ms, rests, BAR)


@query("J30_mark_groups", with_ctes("heads") + """
    , s AS (SELECT doc_id, page, cx - 8 AS sx, cy - 4 AS top, cy + 4 AS bottom FROM heads WHERE confidence < 0.015),
    t AS (SELECT DISTINCT h.head_id FROM heads h JOIN s ON s.doc_id = h.doc_id AND s.page = h.page AND s.sx BETWEEN h.cx - 2.5 * 4 AND h.cx + 0.2 * 4
          AND h.cy BETWEEN s.top - 6 AND s.bottom + 6)
    SELECT head_id AS note_id, arp OR rolled AS arpeggiate, rolled FROM (
      SELECT head_id, arp, bool_or(hit) OVER c AND NOT bool_and(arp) OVER c AS rolled FROM (
        SELECT *, head_id IN (SELECT head_id FROM t) AS hit, midi % 2 = 0 AS arp, coalesce(onset, 9.0) AS o FROM heads) WINDOW c AS (PARTITION BY doc_id, measure, staff, o))
    """.replace("\n    , s", ", s"))
def _(spark, d):
    h = heads(spark, d)
    n = h.select("doc_id", "measure", "page", F.col("head_id").alias("note_id"), F.col("staff").alias("part"), F.coalesce("onset", F.lit(9.0)).alias("start"),
                 (F.col("midi") % 2 == 0).alias("arpeggiate"), F.col("cx").alias("x0"), (F.col("cy") - 2).alias("y0"), (F.col("cy") + 2).alias("y1"))
    signs = h.filter(F.col("confidence") < 0.015).select("doc_id", "page", (F.col("cx") - 8).alias("sx"), (F.col("cy") - 4).alias("top"), (F.col("cy") + 4).alias("bottom"))
    return A.mark_groups(n, signs, BAR, ["doc_id", "page"]).select("note_id", "arpeggiate", "rolled")


@query("P18_score_only_fallback", with_ctes("heads") + """
    SELECT head_id AS note_id, CASE WHEN doc_id % 4 <> 1 THEN head_id END AS head_id, CASE WHEN doc_id % 4 = 1 THEN midi ELSE midi + 1 END AS midi,
           CASE WHEN doc_id % 4 = 1 THEN 'musicxml-only' ELSE 'matched-omr' END AS pitch_source FROM heads""")
def _(spark, d):
    h = heads(spark, d)
    n = h.select("doc_id", F.col("head_id").alias("note_id"), "head_id", "confidence", (F.col("midi") + 1).alias("midi"), F.col("midi").alias("xml_midi"), F.lit("matched-omr").alias("pitch_source"))
    ms = h.select("doc_id", "measure").distinct().withColumn("warnings", F.array().cast("array<string>"))
    failed = h.select("doc_id").filter(F.col("doc_id") % 4 == 1)
    return A.score_only_fallback(n, ms, failed, DOC)[0].select("note_id", "head_id", "midi", "pitch_source")


@query("A14_alignment_stats", with_ctes("heads") + """
    , n AS (SELECT doc_id, measure, CASE WHEN onset IS NOT NULL THEN head_id END AS hd, midi % 5 <> 0 AS same, CASE seq % 7 WHEN 0 THEN 'v' WHEN 1 THEN 'o' WHEN 2 THEN 't' ELSE 'm' END AS s FROM heads),
    b AS (SELECT doc_id, measure, count(*) FILTER (hd IS NOT NULL AND s = 'm') AS m, count(*) FILTER (hd IS NULL) AS u, count(*) FILTER (hd IS NOT NULL AND s = 'm' AND NOT same) AS c,
                 count(*) FILTER (s = 'v') AS v, count(*) FILTER (s = 'o') AS o, count(*) FILTER (s <> 'm') AS r, max(measure) % 3 = 1 AS mm FROM n GROUP BY 1, 2)
    SELECT doc_id, CAST(sum(m) AS BIGINT) AS notes_matched, CAST(sum(u) AS BIGINT) AS notes_unmatched, CAST(sum(c) AS BIGINT) AS pitch_corrections,
           CAST(sum(v) AS BIGINT) AS notes_recovered_from_vector_pdf, CAST(sum(o) AS BIGINT) AS notes_recovered_from_omr_onsets, CAST(sum(r) AS BIGINT) AS notes_recovered,
           count(*) FILTER (u > 0) AS measures_without_note_positions, count(*) FILTER (mm) AS measure_count_mismatch,
           count(DISTINCT measure // 2) FILTER (measure // 2 % 2 = 1) AS pages_without_regions FROM b GROUP BY 1""".replace("\n    , n", ", n"))
def _(spark, d):
    h = heads(spark, d)
    src = (F.when(F.col("seq") % 7 == 0, "pdf-vector-recovered").when(F.col("seq") % 7 == 1, "omr-recovered-onset").when(F.col("seq") % 7 == 2, "omr-recovered-tail")
           .otherwise("matched-omr"))
    n = h.select("doc_id", F.col("measure").alias("measure_index"), F.when(F.col("onset").isNotNull(), F.col("head_id")).alias("head_id"), "midi",
                 F.when(F.col("midi") % 5 == 0, F.col("midi") + 1).otherwise(F.col("midi")).alias("xml_midi"), src.alias("pitch_source"))
    ms = h.select("doc_id", "measure").distinct().withColumn("count_mismatch", F.col("measure") % 3 == 1)
    pages = h.select("doc_id", "page").distinct().withColumns({"read": F.lit(True), "regions": F.when(F.col("page") % 2 == 1, 0).otherwise(3)})
    return A.alignment_stats(n, ms, pages, DOC)


@query("S11_page_overrides", with_ctes("bars") + """
    , o AS (SELECT doc_id, page, measure_index, 'r' || measure_index AS label FROM bars WHERE (doc_id + page) % 3 = 0 AND NOT (page = 2 AND measure_index % 16 = 5)),
    k AS (SELECT doc_id, page, label, row_number() OVER (PARTITION BY doc_id, page ORDER BY measure_index) AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM bars),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY measure_index) AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM o)
    SELECT q.doc_id, q.page, q.measure_index, CASE WHEN k.n = q.n THEN k.label ELSE q.label END AS label FROM q LEFT JOIN k ON k.doc_id = q.doc_id AND k.page = q.page AND k.k = q.k
    UNION ALL SELECT doc_id, page, measure_index, label FROM bars WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = bars.doc_id AND o.page = bars.page)"""
       .replace("\n    , o", ", o"))
def _(spark, d):
    b = bars(spark, d).select("doc_id", "page", "measure_index", "label")
    redone = b.filter(((F.col("doc_id") + F.col("page")) % 3 == 0) & ~((F.col("page") == 2) & (F.col("measure_index") % 16 == 5)))
    return A.apply_page_overrides(b, redone.withColumn("label", F.concat(F.lit("r"), F.col("measure_index").cast("string"))), DOC)


# --- performed timeline ------------------------------------------------------------------------------

@query("W10_stagger", with_ctes("timed") + """
    SELECT doc_id, source_id, round(start_beat + CASE WHEN a THEN late ELSE 0 END, 6) AS start_beat, round(duration - CASE WHEN a THEN late ELSE 0 END, 6) AS duration FROM (
      SELECT *, part_key % 2 = 0 AS a, least(0.08::DOUBLE * (row_number() OVER (PARTITION BY doc_id, start_beat, part_key % 2 = 0 ORDER BY midi, source_id) - 1), duration * 0.3) AS late FROM timed)""")
def _(spark, d):
    out = P.stagger(timed(spark, d).withColumn("arpeggiate", F.col("part_key") % 2 == 0), DOC)
    return out.select("doc_id", "source_id", F.round("start_beat", 6).alias("start_beat"), F.round("duration", 6).alias("duration"))


def _dynamics(spark, d):
    return marked(spark, d, 3).select("doc_id", "part", "staff", "start_beat", F.col("slot").alias("seq"), (40 + F.col("part_key") % 60).alias("value"))


_DYN = """(SELECT max({'at': m.start_beat, 'seq': m.slot, 'v': 40 + m.part_key % 60}) FROM timed m WHERE m.line_number = 3 AND m.doc_id = n.doc_id
    AND m.staff = n.staff AND m.start_beat <= n.start_beat + 1e-8)"""


@query("W11_velocity", with_ctes("timed") + f"""
    SELECT doc_id, source_id, least(127.0::DOUBLE, greatest(1.0, coalesce(dyn.v, 80.0) + {_ART})) AS velocity, duration * {_FACTOR} AS key_duration
    FROM (SELECT *, {_DYN} AS dyn FROM timed n)""")
def _(spark, d):
    out = P.velocity(timed(spark, d), _dynamics(spark, d), DOC, _width(spark, d))
    return out.select("doc_id", "source_id", "velocity", "key_duration")


@query("W15_ramps", with_ctes("timed").replace("WITH", "WITH RECURSIVE", 1) + f"""
    , w AS (SELECT *, CASE flag WHEN 'N' THEN 'crescendo' WHEN 'A' THEN 'diminuendo' ELSE 'stop' END AS kind, slot % 3 = 0 AS nr FROM timed WHERE line_number IN (2, 5)),
    p AS (SELECT *, lag(kind) OVER o AS pk, lag(start_beat) OVER o AS f FROM w WINDOW o AS (PARTITION BY doc_id, staff, nr ORDER BY start_beat, slot)),
    s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, staff ORDER BY t, slot) AS r FROM (
          SELECT doc_id, staff, slot, f AS start_beat, start_beat AS t, pk, (SELECT min(n.start_beat) FROM timed n WHERE n.doc_id = p.doc_id AND n.staff = p.staff
                 AND n.start_beat >= p.f AND n.start_beat < p.start_beat) AS first_note
          FROM p WHERE kind = 'stop' AND pk <> 'stop' AND start_beat > f) WHERE first_note IS NOT NULL),
    g AS (SELECT n.*, coalesce({_DYN}.v, 80) AS printed, CASE WHEN pk = 'crescendo' THEN 16.0::DOUBLE ELSE -16.0::DOUBLE END AS change,
            (SELECT first(40 + m.part_key % 60 ORDER BY m.slot) FROM timed m WHERE m.line_number = 3 AND m.doc_id = n.doc_id AND m.staff = n.staff
             AND m.start_beat = n.t) AS target,
            (SELECT max(i.r) FROM s i WHERE i.doc_id = n.doc_id AND i.staff = n.staff AND i.r < n.r AND i.first_note <= n.start_beat) AS up FROM s n),
    v AS (SELECT doc_id, staff, r, printed::DOUBLE AS level FROM g WHERE up IS NULL
          UNION ALL
          SELECT j.doc_id, j.staff, j.r, v.level + (coalesce(i.target, v.level + i.change) - v.level)
                 * ((SELECT max(n.start_beat) FROM timed n WHERE n.doc_id = i.doc_id AND n.staff = i.staff AND n.start_beat >= i.start_beat AND n.start_beat < i.t
                     AND n.start_beat <= j.start_beat) - i.start_beat) / (i.t - i.start_beat)
          FROM v JOIN g i ON i.doc_id = v.doc_id AND i.staff = v.staff AND i.r = v.r JOIN g j ON j.doc_id = v.doc_id AND j.staff = v.staff AND j.up = v.r)
    SELECT n.doc_id, n.source_id, n.start_beat, round(level + (coalesce(target, level + change) - level) * (n.start_beat - g.start_beat) / (g.t - g.start_beat), 6) AS value
    FROM timed n JOIN g ON n.doc_id = g.doc_id AND n.staff = g.staff AND n.start_beat >= g.start_beat AND n.start_beat < g.t
    JOIN v ON v.doc_id = g.doc_id AND v.staff = g.staff AND v.r = g.r""".replace("\n    , w", ", w"))
def _(spark, d):
    kind = F.when(F.col("flag") == "N", "crescendo").when(F.col("flag") == "A", "diminuendo").otherwise("stop")
    wedges = marked(spark, d, 2, 5).select("doc_id", "part", "staff", F.when(F.col("slot") % 3 == 0, "1").otherwise("2").alias("number"), "start_beat",
                                           F.col("slot").alias("seq"), kind.alias("value"))
    out = P.ramps(wedges, _dynamics(spark, d), timed(spark, d), DOC, _width(spark, d))
    return out.select("doc_id", "source_id", "start_beat", F.round("value", 6).alias("value"))


def _sounding(spark, d):
    return timed(spark, d).withColumns({"key_duration": F.col("duration") * 0.75, "velocity": 64 + F.col("part_key") % 40})


@query("W12_merge_ties", with_ctes("timed") + """
    , p AS (SELECT *, lag(start_beat + duration) OVER o AS pe, lag(tie_start) OVER o AS pt FROM timed WINDOW o AS (PARTITION BY doc_id, voice, midi ORDER BY start_beat, source_id)),
    j AS (SELECT *, coalesce(tie_stop AND pt AND abs(pe - start_beat) < 1e-6, false) AS jo FROM p),
    e AS (SELECT *, sum(CASE WHEN jo THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, voice, midi ORDER BY start_beat, source_id) AS ev FROM j)
    SELECT doc_id, voice, midi, min(start_beat) AS start_beat, last(start_beat + duration * 0.75 ORDER BY start_beat, source_id) - min(start_beat) AS duration,
           first(source_id ORDER BY start_beat, source_id) AS source_id, first(64 + part_key % 40 ORDER BY start_beat, source_id) AS velocity, count(*) AS segments,
           string_agg(source_id, ',' ORDER BY start_beat, source_id) AS segment_ids, bool_or(tie_stop AND NOT jo) AS orphan_stop FROM e GROUP BY doc_id, voice, midi, ev""".replace("\n    , p", ", p"))
def _(spark, d):
    return P.merge_ties(_sounding(spark, d), DOC, _width(spark, d)).drop("part").withColumn("segment_ids", F.array_join("segment_ids", ","))


@query("W13_collapse_strikes", with_ctes("timed") + """
    SELECT doc_id, midi, min(start_beat) AS start_beat, max(duration * 0.75) AS duration, max(64 + part_key % 40) AS velocity, first(source_id ORDER BY voice, source_id) AS source_id, count(*) AS strikes,
           string_agg(source_id, ',' ORDER BY voice, source_id) AS segment_ids FROM timed WHERE NOT tie_start AND NOT tie_stop GROUP BY doc_id, midi, round(start_beat, 6)""")
def _(spark, d):
    out = P.collapse_strikes(_sounding(spark, d).filter("not tie_start and not tie_stop"), DOC).drop("part")
    return out.withColumn("segment_ids", F.array_join("segment_ids", ","))


_EVENTS = """, p AS (SELECT *, lag(start_beat + duration) OVER o AS pe, lag(tie_start) OVER o AS pt FROM timed WINDOW o AS (PARTITION BY doc_id, voice, midi ORDER BY start_beat, source_id)),
    j AS (SELECT *, coalesce(tie_stop AND pt AND abs(pe - start_beat) < 1e-6, false) AS jo FROM p),
    e AS (SELECT *, sum(CASE WHEN jo THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, voice, midi ORDER BY start_beat, source_id) AS ev FROM j),
    tied AS (SELECT doc_id, voice, midi, min(start_beat) AS start_beat, last(start_beat + duration * 0.75 ORDER BY start_beat, source_id) - min(start_beat) AS duration,
           first(source_id ORDER BY start_beat, source_id) AS source_id, first(64 + part_key % 40 ORDER BY start_beat, source_id) AS velocity, first(staff - 1 ORDER BY start_beat, source_id) AS role,
           list(source_id ORDER BY start_beat, source_id) AS ids, bool_or(tie_stop AND NOT jo) AS orphan_stop, first(NOT tie_start AND NOT tie_stop AND NOT is_grace ORDER BY start_beat, source_id) AS plain
           FROM e GROUP BY doc_id, voice, midi, ev),
    events AS (SELECT doc_id, midi, min(start_beat) AS start_beat, max(duration) AS duration, max(velocity) AS velocity, first(source_id ORDER BY voice, source_id) AS source_id,
           first(role ORDER BY voice, source_id) AS role, flatten(list(ids ORDER BY voice, source_id)) AS ids, bool_or(orphan_stop) AS orphan_stop
           FROM tied GROUP BY doc_id, midi, round(start_beat, 6), CASE WHEN plain THEN NULL ELSE {'v': voice, 's': source_id} END)"""


def _events(spark, d):
    return P.sounding_events(_sounding(spark, d).withColumn("role", F.col("staff") - 1), DOC, _width(spark, d))


@query("W13_sounding_events", with_ctes("timed") + _EVENTS + """
    SELECT doc_id, midi, start_beat, duration, velocity, source_id, role, orphan_stop, array_to_string(ids, ',') AS segment_ids FROM events""")
def _(spark, d):
    return _events(spark, d).drop("part").withColumn("segment_ids", F.array_join("segment_ids", ","))


@query("W14_apply_pedal", with_ctes("timed") + """
    , p AS (SELECT doc_id, start_beat, slot, CASE flag WHEN 'N' THEN 'start' WHEN 'R' THEN 'stop' ELSE 'change' END AS v FROM timed WHERE line_number IN (5, 6)),
    a AS (SELECT *, start_beat + duration AS e, (SELECT max({'at': p.start_beat, 'seq': p.slot, 'v': p.v}).v FROM p WHERE p.doc_id = n.doc_id AND p.start_beat <= n.start_beat + n.duration + 1e-8) AS st,
                 (SELECT min(p.start_beat) FROM p WHERE p.doc_id = n.doc_id AND p.v IN ('stop', 'change') AND p.start_beat > n.start_beat + n.duration + 1e-8) AS nx FROM timed n)
    SELECT doc_id, source_id, greatest(0.0, least(8.0, CASE WHEN st IN ('start', 'change') THEN coalesce(nx, 8.0) ELSE e END) - start_beat) AS duration FROM a""".replace("\n    , p", ", p"))
def _(spark, d):
    return _pedalled(spark, d, timed(spark, d)).select("doc_id", "source_id", "duration")


def _pedalled(spark, d, sounding):
    value = F.when(F.col("flag") == "N", "start").when(F.col("flag") == "R", "stop").otherwise("change")
    pedals = marked(spark, d, 5, 6).select("doc_id", "part", "start_beat", F.col("slot").alias("seq"), value.alias("value"))
    totals = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("total_beats", F.lit(8.0))
    return P.apply_pedal(sounding, pedals, totals, DOC, _width(spark, d))


@query("F18_expand_ornaments", with_ctes("timed") + """
    SELECT doc_id, source_id, CAST(i AS INTEGER) AS part_of, CAST(CASE WHEN n IS NULL OR i = n + 1 OR i % 2 = (CASE WHEN o = 'm' THEN 1 ELSE 0 END) THEN 71 ELSE 72 END AS INTEGER) AS midi,
           round(CASE WHEN n IS NULL THEN start_beat ELSE start_beat + (i - 1) * u END, 6) AS start_beat,
           round(CASE WHEN n IS NULL THEN duration WHEN i = n + 1 THEN duration - u * n ELSE u * 0.9 END, 6) AS duration FROM (
      SELECT *, unnest(CASE WHEN n IS NULL THEN [0] WHEN duration - u * n > 0 THEN range(1, n + 2) ELSE range(1, n + 1) END) AS i FROM (
        SELECT *, CASE o WHEN 'm' THEN 3 END AS n, CASE o WHEN 'm' THEN least(0.125, duration / 3) END AS u FROM (
          SELECT *, CASE WHEN part_key % 5 = 0 AND NOT tie_start AND NOT tie_stop THEN 'm' END AS o FROM timed)))""")
def _(spark, d):
    n = timed(spark, d).withColumns({"midi": F.lit(71), "xml_midi": F.lit(71), "step": F.lit("B"), "octave": F.lit(4), "key_fifths": F.lit(0), "transpose": F.lit(0),
                                     "key_duration": F.col("duration"), "ornaments": F.when(F.col("part_key") % 5 == 0, F.array(F.lit("mordent"))).otherwise(F.array().cast("array<string>"))})
    return P.expand_ornaments(n, 32).select("doc_id", "source_id", "part_of", "midi", F.round("start_beat", 6).alias("start_beat"), F.round("duration", 6).alias("duration"))


@query("A36_distinct_midis", with_ctes("notes") + """
    SELECT doc_id, measure, array_to_string(list_sort(list(DISTINCT midi)), ',') AS distinct_midis FROM notes GROUP BY 1, 2""")
def _(spark, d):
    return P.distinct_midis(B.score_notes(spark, d), BAR).withColumn("distinct_midis", F.array_join(F.transform("distinct_midis", lambda m: m.cast("string")), ","))


@query("T04_note_order", with_ctes("timed") + """
    SELECT doc_id, source_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_beat, midi, source_id) - 1 AS seq FROM timed""")
def _(spark, d):
    return P.note_order(timed(spark, d), DOC, chunk=X.for_long(B.table(spark, d, "lineitem"), ["l_orderkey"], X.chunk_of("start_beat", 64))).select("doc_id", "source_id", "seq")


def _tempo(spark, d):
    ev = marked(spark, d, 6, 7).select("doc_id", "start_beat", (60 + F.col("part_key") % 140).alias("value"), F.lit(1.0).alias("beat_unit_quarters"), F.col("slot").alias("seq"))
    docs = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return P.tempo_map(ev, docs, DOC)


_TEMPO = """tm AS (SELECT doc_id, start_beat, last(bpm ORDER BY slot) AS bpm FROM (
      SELECT doc_id, start_beat, slot, CAST(60 + part_key % 140 AS DOUBLE) AS bpm FROM timed WHERE line_number IN (6, 7)
      UNION ALL SELECT DISTINCT doc_id, 0.0, -1, 96.0 FROM timed) GROUP BY 1, 2)"""


@query("W16_tempo_map", with_ctes("timed").rstrip() + ", " + _TEMPO + "SELECT doc_id, start_beat, bpm FROM tm")
def _(spark, d):
    return _tempo(spark, d).select("doc_id", "start_beat", "bpm")


_CLOCK = """cl AS (SELECT *, sum(coalesce((start_beat - pb) * ps, 0)) OVER (PARTITION BY doc_id ORDER BY start_beat) AS seconds FROM (
      SELECT *, lag(start_beat) OVER o AS pb, lag(spb) OVER o AS ps FROM (
        SELECT *, 60 / (bpm * least(2.0, 300 / max(bpm) OVER (PARTITION BY doc_id))) AS spb FROM tm) WINDOW o AS (PARTITION BY doc_id ORDER BY start_beat)))"""


@query("W17_tempo_clock", with_ctes("timed").rstrip() + ", " + _TEMPO + ", " + _CLOCK + """
    SELECT n.doc_id, n.source_id, round(c.seconds + (n.start_beat - c.start_beat) * c.spb, 6) AS seconds, round(n.start_beat, 6) AS beat
    FROM timed n JOIN cl c ON c.doc_id = n.doc_id AND c.start_beat = (SELECT max(start_beat) FROM cl x WHERE x.doc_id = n.doc_id AND x.start_beat <= n.start_beat)""")
def _(spark, d):
    width = _width(spark, d)
    clock = P.tempo_clock(_tempo(spark, d), DOC, 2.0, chunk_width=width)
    pts = timed(spark, d).select("doc_id", "source_id", F.col("start_beat").alias("beat"))
    at = P.seconds_at(pts, clock, DOC, chunk_width=width)
    back = P.beat_at(at.select("doc_id", "source_id", (F.col("seconds") + 1e-9).alias("seconds")), clock, DOC, chunk_width=width)
    return back.select("doc_id", "source_id", F.round("seconds", 6).alias("seconds"), F.round("beat", 6).alias("beat"))


@query("J19_active_at", with_ctes("timed") + """
    SELECT p.doc_id, p.slot AS point, n.source_id FROM timed p JOIN timed n ON n.doc_id = p.doc_id AND p.start_beat + 0.25 >= n.start_beat - 1e-9
      AND p.start_beat + 0.25 < n.start_beat + n.duration * 0.75 - 1e-9""")
def _(spark, d):
    t = _sounding(spark, d)
    pts = t.select("doc_id", F.col("slot").alias("point"), (F.col("start_beat") + 0.25).alias("beat"))
    return P.active_at(t.select("doc_id", "source_id", "start_beat", "duration", "key_duration", "is_grace"), pts, DOC).select("doc_id", "point", "source_id")


@query("J20_clip_to_window", with_ctes("timed") + """
    SELECT doc_id, source_id, greatest(start_beat, 0.75) AS clip_start, least(start_beat + duration, 2.25) AS clip_end FROM timed
    WHERE start_beat < 2.25 - 1e-9 AND start_beat + duration > 0.75 + 1e-9""")
def _(spark, d):
    return P.clip_to_window(timed(spark, d), 0.75, 2.25).select("doc_id", "source_id", "clip_start", "clip_end")


@query("W18_name_spans", with_ctes("timed") + """
    , k AS (SELECT *, start_beat + greatest(0.1::DOUBLE, CASE WHEN is_grace THEN 0 ELSE duration END) AS e FROM timed),
    s AS (SELECT doc_id, midi, start_beat, first(source_id ORDER BY source_id) AS source_id, first(tie_stop ORDER BY source_id) AS ts, max(e) AS e FROM k GROUP BY 1, 2, 3),
    c AS (SELECT *, CASE WHEN coalesce(ts AND abs(lag(e) OVER o - start_beat) < 1e-6, false) THEN 0 ELSE 1 END AS st FROM s WINDOW o AS (PARTITION BY doc_id, midi ORDER BY start_beat)),
    g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, midi ORDER BY start_beat) AS g FROM c),
    n AS (SELECT doc_id, first(source_id ORDER BY start_beat) AS source_id, max(e) AS e FROM g GROUP BY doc_id, midi, g)
    SELECT k.doc_id, k.source_id, coalesce(n.e, -1.0) AS name_end FROM k LEFT JOIN n ON n.doc_id = k.doc_id AND n.source_id = k.source_id""".replace("\n    , k", ", k"))
def _(spark, d):
    return P.name_spans(timed(spark, d), DOC, 0.1, _width(spark, d)).select("doc_id", "source_id", "name_end")


@query("J24_apply_corrections", with_ctes("timed") + """
    SELECT n.doc_id, n.source_id, CASE WHEN hit THEN cm ELSE midi END AS midi, CASE WHEN hit THEN measure * 2.0::DOUBLE + co ELSE start_beat END AS start_beat,
           CASE WHEN hit THEN least(cd, 2.0 - co) ELSE duration END AS duration, CASE WHEN hit THEN least(cd, 2.0 - co) * 0.75::DOUBLE ELSE duration * 0.75 END AS key_duration, hit AS corrected
    FROM (SELECT *, coalesce(part_key % 4 = 0 AND 15 + part_key % 110 BETWEEN 21 AND 108 AND supp_key % 5 * 0.6::DOUBLE < 2.0 AND tax > 0.005, false) AS hit, 15 + part_key % 110 AS cm,
                 supp_key % 5 * 0.6::DOUBLE AS co, tax * 50 AS cd FROM timed) n""")
def _(spark, d):
    return _corrected(spark, d)[1].select("doc_id", "source_id", "midi", "start_beat", "duration", "key_duration", "corrected")


def _corrected(spark, d):
    """(notes as written, notes as a reader corrects them)."""
    t = _sounding(spark, d).withColumns({"printed_id": F.col("source_id"), "hand": F.lit(None).cast("string"), "role": F.col("staff") - 1, "measure_index": F.col("measure")})
    c = t.filter(F.col("part_key") % 4 == 0).select("doc_id", "printed_id", (15 + F.col("part_key") % 110).alias("midi"), F.lit("left").alias("hand"),
                                                    (F.col("supp_key") % 5 * 0.6).alias("offset"), (F.col("tax") * 50).alias("duration"))
    ms = t.select("doc_id", "measure_index").distinct().withColumns({"start_beat": F.col("measure_index") * 2.0, "length": F.lit(2.0)})
    return t, P.apply_corrections(t, ms, c, DOC)


@query("J24_correct_audio", with_ctes("timed") + _EVENTS + """,
    pe AS (SELECT doc_id, start_beat, slot, CASE flag WHEN 'N' THEN 'start' WHEN 'R' THEN 'stop' ELSE 'change' END AS v FROM timed WHERE line_number IN (5, 6)),
    st AS (SELECT *, (SELECT max({'at': pe.start_beat, 'seq': pe.slot, 'v': pe.v}).v FROM pe WHERE pe.doc_id = n.doc_id AND pe.start_beat <= n.start_beat + n.duration + 1e-8) AS st,
                  (SELECT min(pe.start_beat) FROM pe WHERE pe.doc_id = n.doc_id AND pe.v IN ('stop', 'change') AND pe.start_beat > n.start_beat + n.duration + 1e-8) AS nx FROM events n),
    au AS (SELECT *, greatest(start_beat, least(8.0, CASE WHEN st IN ('start', 'change') THEN coalesce(nx, 8.0) ELSE start_beat + duration END)) AS ends FROM st),
    co AS (SELECT doc_id, source_id, coalesce(part_key % 4 = 0 AND 15 + part_key % 110 BETWEEN 21 AND 108 AND supp_key % 5 * 0.6::DOUBLE < 2.0 AND tax > 0.005, false) AS hit, 15 + part_key % 110 AS cm,
                  measure * 2.0::DOUBLE + supp_key % 5 * 0.6::DOUBLE AS cs, least(tax * 50, 2.0 - supp_key % 5 * 0.6::DOUBLE) * 0.75 AS cd, midi, staff, start_beat, duration * 0.75 AS kd FROM timed),
    sg AS (SELECT doc_id, source_id AS audio_id, ends, unnest(ids) AS source_id, generate_subscripts(ids, 1) AS i FROM au),
    pr AS (SELECT sg.doc_id, audio_id, ends, first(CASE WHEN hit THEN cs ELSE start_beat END ORDER BY i) AS s, first(CASE WHEN hit THEN cm ELSE midi END ORDER BY i) AS fm,
                  first(cm ORDER BY i) FILTER (WHERE hit) AS em, first(CASE WHEN hit THEN 1 ELSE staff - 1 END ORDER BY i) AS role,
                  max(CASE WHEN hit THEN cs + cd ELSE start_beat + kd END) AS ne, max(start_beat + kd) AS oe
           FROM sg JOIN co ON co.doc_id = sg.doc_id AND co.source_id = sg.source_id GROUP BY sg.doc_id, audio_id, ends)
    SELECT doc_id, audio_id, coalesce(em, fm) AS midi, role, round(s, 6) AS start_beat, round(greatest(ne, CASE WHEN ends > oe + 1e-8 THEN ends ELSE 0 END) - s, 6) AS duration FROM pr""")
def _(spark, d):
    written, corrected = _corrected(spark, d)
    audio = _pedalled(spark, d, _events(spark, d)).withColumnRenamed("source_id", "audio_id")
    out = P.correct_audio(audio, corrected, written, DOC)
    return out.select("doc_id", "audio_id", "midi", "role", F.round("start_beat", 6).alias("start_beat"), F.round("duration", 6).alias("duration"))


@query("J25_resolve_labels", with_ctes("timed") + """
    SELECT doc_id, source_id AS label_id, CAST(slot * 10 + CASE WHEN part_key % 3 = 0 THEN supp_key ELSE 0 END AS DOUBLE) AS x,
           CASE WHEN part_key % 3 = 0 AND supp_key % 2 = 0 THEN 're' ELSE 'do' END AS text, part_key % 3 = 0 AS edited FROM timed WHERE NOT (part_key % 3 = 0 AND part_key % 7 = 0)""")
def _(spark, d):
    t = timed(spark, d).withColumn("label_id", F.col("source_id"))
    labels = t.select("doc_id", "label_id", (F.col("slot") * 10.0).alias("x"), F.lit(0.0).alias("y"), F.lit("C").alias("text"))
    edits = t.filter(F.col("part_key") % 3 == 0).select("doc_id", "label_id", F.col("supp_key").cast("double").alias("dx"), F.lit(None).cast("double").alias("dy"),
                                                        F.when(F.col("supp_key") % 2 == 0, "D").alias("text"), (F.col("part_key") % 7 == 0).alias("hidden"), F.lit(None).cast("string").alias("color"))
    return P.resolve_labels(labels, edits, DOC, "solfege").select("doc_id", "label_id", "x", "text", "edited")


def _grace_notes(spark, d):
    n = timed(spark, d)
    pct = F.lit(None).cast("double")
    return n.select("doc_id", "measure", "part", "voice", F.col("source_id").alias("note_id"), F.col("slot").alias("seq"), (F.col("start_beat") - F.col("measure")).alias("start"),
                    F.when(F.col("is_grace"), 0.0).otherwise(F.col("duration")).alias("duration"), "is_grace", (F.col("part_key") % 4 == 0).alias("chord"),
                    F.when(F.col("is_grace") & (F.col("supp_key") % 4 == 0), 0.5).alias("make_time"),
                    F.when(F.col("is_grace") & (F.col("supp_key") % 4 == 1), 20.0).alias("steal_previous"), pct.alias("steal_following"))


@query("W20_grace_timing")
def _(spark, d):
    notes, _ = P.grace_timing(_grace_notes(spark, d), BAR)
    return notes.select("doc_id", "measure", "note_id", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"))


_INSERTS = """, ev AS (SELECT doc_id, measure_index AS measure, measure_index AS event_id, CAST(sk % 4 AS DOUBLE) AS beat, content, pk, sk FROM bars),
    i AS (SELECT doc_id, measure_index AS measure, CAST(pk % 3 AS DOUBLE) AS at, CAST(0.25 * (1 + sk % 3) AS DOUBLE) AS amount FROM bars WHERE pk % 2 = 0
      UNION ALL SELECT doc_id, measure_index, CAST(sk % 4 AS DOUBLE), 0.5 FROM bars WHERE sk % 3 = 0)"""


def _bar_inserts(b):
    """Time put into bars: at a beat of the part's, and at one of the supplier's."""
    one = b.where("pk % 2 = 0").select("doc_id", F.col("measure_index").alias("measure"), (F.col("pk") % 3 * 1.0).alias("at"), (0.25 * (1 + F.col("sk") % 3)).alias("amount"))
    return one.unionByName(b.where("sk % 3 = 0").select("doc_id", F.col("measure_index").alias("measure"), (F.col("sk") % 4 * 1.0).alias("at"), F.lit(0.5).alias("amount")))


@query("W20_events_after_inserts", with_ctes("bars") + _INSERTS + """
    SELECT doc_id, measure, beat + coalesce((SELECT sum(amount) FROM i WHERE i.doc_id = ev.doc_id AND i.measure = ev.measure AND i.at <= ev.beat), 0) AS beat FROM ev""")
def _(spark, d):
    b = bars(spark, d)
    events = b.select("doc_id", F.col("measure_index").alias("measure"), F.col("measure_index").alias("event_id"), (F.col("sk") % 4 * 1.0).alias("beat"))
    return P.insert_time(events, _bar_inserts(b), BAR, ["event_id"], "beat", None).select("doc_id", "measure", "beat")


@query("W20_notes_after_inserts", with_ctes("bars") + _INSERTS + """
    SELECT doc_id, measure, round(beat + coalesce((SELECT sum(amount) FROM i WHERE i.doc_id = ev.doc_id AND i.measure = ev.measure AND i.at <= ev.beat), 0), 6) AS start,
           round(content / 3 + coalesce((SELECT sum(amount) FROM i WHERE i.doc_id = ev.doc_id AND i.measure = ev.measure AND i.at > ev.beat AND i.at < ev.beat + content / 3), 0), 6) AS duration FROM ev""")
def _(spark, d):
    b = bars(spark, d)
    notes = b.select("doc_id", F.col("measure_index").alias("measure"), F.col("measure_index").alias("note_id"), (F.col("sk") % 4 * 1.0).alias("start"), (F.col("content") / 3).alias("duration"))
    return P.insert_time(notes, _bar_inserts(b), BAR, ["note_id"]).select("doc_id", "measure", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"))


@query("W21_bar_lengths", with_ctes("bars") + _INSERTS + """
    SELECT doc_id, measure_index AS measure, round(content + coalesce((SELECT sum(amount) FROM i WHERE i.doc_id = bars.doc_id AND i.measure = measure_index), 0), 6) AS length FROM bars""")
def _(spark, d):
    b = bars(spark, d)
    lengths = b.select("doc_id", F.col("measure_index").alias("measure"), F.col("content").alias("length"))
    return P.lengthen_bars(lengths, _bar_inserts(b), BAR).select("doc_id", "measure", F.round("length", 6).alias("length"))


_HOLDS = with_ctes("timed").replace("WITH", "WITH RECURSIVE", 1) + """
    , n AS (SELECT doc_id, measure, source_id AS note_id, start_beat AS start, duration, part_key % 3 = 0 AS fermata FROM timed),
    held AS (SELECT doc_id, measure, start + duration AS held_at, list({'s': start, 'd': duration}) AS held FROM n WHERE fermata GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, measure ORDER BY held_at) AS k FROM held),
    folded AS (SELECT doc_id, measure, k, [{'at': held_at, 'amount': greatest(0.5, least(2.0, 0.5 * list_max([h.d FOR h IN held])))}] AS acc FROM ranked WHERE k = 1
      UNION ALL SELECT r.doc_id, r.measure, r.k, list_append(f.acc, {'at': r.held_at, 'amount': greatest(0.5, least(2.0, 0.5 * (
        SELECT max(h.d + coalesce((SELECT sum(a.amount) FROM (SELECT unnest(f.acc) AS a) WHERE a.at > h.s + 1e-8), 0)) FROM (SELECT unnest(r.held) AS h))))})
      FROM folded f JOIN ranked r ON r.doc_id = f.doc_id AND r.measure = f.measure AND r.k = f.k + 1),
    holds AS (SELECT doc_id, measure, h.at AS at, h.amount AS amount FROM (SELECT doc_id, measure, unnest(max_by(acc, k)) AS h FROM folded GROUP BY 1, 2))"""


@query("W21_fermata_hold", _HOLDS.replace("\n    , n AS", ", n AS") + """
    SELECT doc_id, measure, note_id, round(start + coalesce((SELECT sum(amount) FROM holds h WHERE h.doc_id = n.doc_id AND h.measure = n.measure AND h.at <= n.start + 1e-8), 0), 6) AS start,
           round(duration + coalesce((SELECT sum(amount) FROM holds h WHERE h.doc_id = n.doc_id AND h.measure = n.measure AND h.at > n.start + 1e-8 AND h.at <= n.start + n.duration + 1e-8), 0), 6) AS duration FROM n""")
def _(spark, d):
    n = timed(spark, d).select("doc_id", "measure", F.col("source_id").alias("note_id"), F.col("start_beat").alias("start"), "duration", (F.col("part_key") % 3 == 0).alias("fermata"))
    return P.fermata_hold(n, BAR).select("doc_id", "measure", "note_id", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"))


@query("W22_state_at_jumps", with_ctes("bars") + """
    , o AS (SELECT doc_id, measure_index AS position, (measure_index * 5) % 64 // 2 AS mi, CAST(measure_index * 4 AS DOUBLE) AS start_beat FROM bars),
    ev AS (SELECT doc_id, measure_index AS mi, CAST(sk % 4 AS DOUBLE) AS beat, CASE pk % 5 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'tempo' WHEN 2 THEN 'pedal' ELSE 'wedge' END AS kind, CAST(40 + pk % 60 AS VARCHAR) AS value FROM bars),
    j AS (SELECT * FROM (SELECT *, lag(mi) OVER (PARTITION BY doc_id ORDER BY position) AS p FROM o) WHERE mi <> coalesce(p, -1) + 1)
    SELECT doc_id, position, start_beat, 'tempo' AS kind, '96.0' AS value, 0 AS rank FROM j UNION ALL SELECT doc_id, position, start_beat, 'dynamic', '80.0', 0 FROM j
    UNION ALL SELECT doc_id, position, start_beat, 'pedal', 'stop', 2 FROM j
    UNION ALL SELECT doc_id, position, start_beat, kind, v, 1 FROM (SELECT j.*, k.kind, (SELECT last(e.value ORDER BY e.mi) FROM ev e WHERE e.doc_id = j.doc_id AND e.kind = k.kind AND e.mi < j.mi) AS v
        FROM j, (VALUES ('dynamic'), ('tempo'), ('pedal')) k(kind)) WHERE v IS NOT NULL
    UNION ALL SELECT o.doc_id, o.position, o.start_beat + e.beat, e.kind, e.value, 3 FROM o JOIN ev e ON e.doc_id = o.doc_id AND e.mi = o.mi""".replace("\n    , o", ", o"))
def _(spark, d):
    b = bars(spark, d)
    order = b.select("doc_id", F.col("measure_index").alias("position"), F.floor(F.col("measure_index") * 5 % 64 / 2).cast("bigint").alias("measure_index"), (F.col("measure_index") * 4.0).alias("start_beat"))
    ev = b.select("doc_id", "measure_index", (F.col("sk") % 4 * 1.0).alias("beat"), F.lit(0).alias("seq"), F.when(F.col("pk") % 5 == 0, "dynamic").when(F.col("pk") % 5 == 1, "tempo").when(F.col("pk") % 5 == 2, "pedal").otherwise("wedge").alias("kind"),
                  F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("staff"), (40 + F.col("pk") % 60).cast("string").alias("value"))
    staves = b.select("doc_id").distinct().withColumns({"part": F.lit(0).cast("bigint"), "staff": F.lit(1).cast("bigint")})
    return P.state_at_jumps(order, ev, staves, DOC, chunk_rows=16).select("doc_id", "position", "start_beat", "kind", "value", "rank")
