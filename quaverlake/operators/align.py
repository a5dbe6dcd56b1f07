"""Aligning the written score with the printed page.

``keys`` names the measure (document and measure index) unless said otherwise. Heads: source_id, role,
onset (NULL when never placed), pitch, voice, cx, ... Notes: note_id, seq, role, start, ...
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quaverlake.functions.pitch import LETTERS, clef_reference, midi_of_diatonic
from quaverlake.operators.asof import asof_join
from quaverlake.operators.bands import stab_join
from quaverlake.operators.ranks import top_n_per_key, upper_median
from quaverlake.operators.segments import for_long, previous, row_index
from quaverlake.session import cut_lineage

TICK = 1e-6
#: Notes and heads of one staff, time and letter that are matched as one row.
FEW = 64
FAILED = "PDF note matching failed; playback uses MusicXML-only score data."
MISSING_PLACED = "A printed measure is missing from the recognized score; this system is placed by measure number."
MISSING_LEFT = "Measure geometry is incomplete; positions are left unassigned."
OCTAVE_DISAGREES = "Octave marking and encoded pitch disagree; the encoded octave is retained."
ARPEGGIO = "Arpeggio read from the printed PDF; this chord is rolled low to high."


def tick(col: Column) -> Column:
    """A beat position as a whole number of millionths, so equal times join by equality."""
    return F.rint(col / TICK).cast("bigint")


def written_diatonic(step: Column, octave: Column) -> Column:
    return F.lit(34) - (octave * 7 + F.array_position(F.array(*[F.lit(x) for x in LETTERS]), step) - 1)


# --- matching --------------------------------------------------------------------------------------

def match_tiered(notes: DataFrame, heads: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """J-16: the head of each note, NULL where none or no single one fits.

    ``notes``: note_id, seq, role, start, voice, is_grace, written_slot, sounding_slot. ``heads``: source_id, role,
    onset, pitch, voice, x. In order of ``seq`` a note takes a free head of its staff and time: one at its
    written place, else at its sounding place, else of its letter; its own voice is preferred, several left
    mean no match. A grace takes the leftmost of the heads without a time. A note with no free candidate
    shares the one head already taken at its written place.

    Taking is sequential only between notes that compete for a head, and those share staff, time and letter: such a
    group is one row, folded in order. Groups of more than ``FEW`` notes and heads are matched in rounds, with the same result;
    they are counted first, unless ``few`` tells that the bars hold no more than that.
    """
    at = [*keys, "role", "__t", "__letter"]
    asked = (notes.withColumn("__t", F.when(~F.col("is_grace"), tick(F.col("start")))).withColumn("__letter", F.pmod("written_slot", F.lit(7)))
             .select(*at, F.struct("seq", "note_id", *[c for c in notes.columns if c not in ("seq", "note_id")]).alias("__note")))
    timed = (heads.withColumn("__t", F.when(F.col("onset").isNotNull(), tick(F.col("onset")))).withColumn("__letter", F.pmod("pitch", F.lit(7)))
             .select(*at, F.struct(F.col("source_id").alias("head"), "pitch", "voice", "x").alias("__head")).dropna(subset=[*keys, "role", "__letter"]))
    if few:
        return _matched(asked, timed, at, notes.columns)
    group = F.struct(*at).alias("__at")  # never NULL, so that times that are missing meet
    both = asked.select(group).unionByName(timed.select(group))
    if not for_long(both, ["__at"], True, FEW):
        return _matched(asked, timed, at, notes.columns)
    crowded = cut_lineage(both.groupBy("__at").count().where(F.col("count") > FEW).select("__at"))
    asked, timed = asked.withColumn("__at", group), timed.withColumn("__at", group)
    one = _matched(asked.join(crowded, "__at", "left_anti").drop("__at"), timed.join(crowded, "__at", "left_anti").drop("__at"), at, notes.columns)
    many = _matched_in_rounds(asked.join(crowded, "__at", "left_semi").select("__note.*"), timed.join(crowded, "__at", "left_semi").select(*at, "__head.*"), keys)
    return one.unionByName(many)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _matched(asked: DataFrame, timed: DataFrame, at: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each note (``__note``) with its ``head_id``, by a fold over the notes and heads (``__head``) of one staff, time and letter."""
    note, head = asked.schema["__note"].dataType.simpleString(), timed.schema["__head"].dataType["head"].dataType.simpleString()
    rows = (asked.withColumn("__head", F.lit(None).cast(timed.schema["__head"].dataType))
            .unionByName(timed.withColumn("__note", F.lit(None).cast(asked.schema["__note"].dataType))))
    groups = rows.groupBy(*at).agg(F.sort_array(F.collect_list("__note")).alias("__notes"), F.collect_list("__head").alias("__heads")).where(F.size("__notes") > 0)

    def step(done: Column, n: Column) -> Column:
        def tier(h: Column) -> Column:
            return F.when(h["pitch"] == n["written_slot"], 1).when(h["pitch"] == n["sounding_slot"], 2).otherwise(3)

        def chosen(free: Column) -> Column:
            best = F.array_min(free)
            alone = F.size(F.filter(free, lambda c: (c["tier"] == best["tier"]) & (c["other"] == best["other"]))) == 1
            shared = F.filter("__heads", lambda h: F.array_contains(done["used"], h["head"]) & (tier(h) == 1))
            return F.when(n["is_grace"] | alone, best["head"]).when((F.size(free) == 0) & (F.size(shared) == 1), F.get(shared, F.lit(0))["head"])

        free = F.transform(F.filter("__heads", lambda h: ~F.array_contains(done["used"], h["head"])), lambda h: F.struct(
            tier(h).alias("tier"), (~F.coalesce(n["voice"] == h["voice"], F.lit(False))).alias("other"), h["x"].alias("x"), h["head"].alias("head")))
        return _let(_let(free, chosen), lambda got: F.struct(
            F.when(got.isNull(), done["used"]).otherwise(F.array_append(done["used"], got)).alias("used"),
            F.array_append(done["out"], F.struct(n.alias("note"), got.alias("head_id"))).alias("out")))

    empty = F.struct(F.array().cast(f"array<{head}>").alias("used"), F.array().cast(f"array<struct<note:{note},head_id:{head}>>").alias("out"))
    found = groups.select(F.explode(F.aggregate("__notes", empty, step, lambda done: done["out"])).alias("__r"))
    return found.select(*[F.col("__r.note")[c].alias(c) for c in columns], F.col("__r.head_id").alias("head_id"))


def _matched_in_rounds(notes: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for groups of any size. Each round settles every note that is first in line at all its heads, so the result is that of
    the sequential pass; the rounds end when no note waits."""
    timed = heads.select(*keys, "role", "__t", "__letter", "head", "pitch", F.col("voice").alias("__hv"), F.col("x").alias("__x"))
    asked = notes.select(*keys, "role", "note_id", "seq", "is_grace", "voice", "written_slot", "sounding_slot",
                         F.when(~F.col("is_grace"), tick(F.col("start"))).alias("__t"),
                         F.pmod("written_slot", F.lit(7)).alias("__letter"))
    cond = [asked[k] == timed[k] for k in (*keys, "role", "__letter")] + [asked["__t"].eqNullSafe(timed["__t"])]
    tier = F.when(F.col("pitch") == F.col("written_slot"), 1).when(F.col("pitch") == F.col("sounding_slot"), 2).otherwise(3)
    pairs = asked.join(timed, cond).select(*[asked[k] for k in keys], asked["note_id"], asked["seq"], "is_grace", "head", "__x",
                                           tier.alias("tier"), F.coalesce(F.col("voice") == F.col("__hv"), F.lit(False)).alias("same"))
    rest, results, used = cut_lineage(pairs), None, None
    at = [*keys, "head"]
    while not rest.isEmpty():
        first = rest.groupBy(*at).agg(F.min("seq").alias("__first"))
        turn = rest.join(first, at).groupBy(*keys, "note_id").agg(F.min(F.col("seq") == F.col("__first")).alias("__go")).filter("__go")
        front = rest.join(turn.select(*keys, "note_id"), [*keys, "note_id"], "left_semi")
        if used is None:
            front = front.withColumn("taken", F.lit(False))
        else:
            front = front.join(used.withColumn("__u", F.lit(True)), at, "left").withColumn("taken", F.col("__u").isNotNull()).drop("__u")
        free = ~F.col("taken")
        choice = F.struct("tier", (~F.col("same")).alias("other"))
        best = front.groupBy(*keys, "note_id", "seq", "is_grace").agg(
            F.min(F.when(free, F.col("tier"))).alias("__tier"), F.min(F.when(free, choice)).alias("__c"))
        seen = front.join(best, [*keys, "note_id", "seq", "is_grace"])
        fits = free & (F.col("tier") == F.col("__tier")) & (F.col("same") | F.col("__c.other"))
        picked = seen.groupBy(*keys, "note_id", "is_grace").agg(
            F.count_if(fits).alias("n"), F.min(F.when(fits, F.col("head"))).alias("one"),
            F.min_by("head", F.when(fits, F.struct("__x", "head"))).alias("left"), F.count_if(free).alias("open"),
            F.count_if(F.col("taken") & (F.col("tier") == 1)).alias("shared_n"),
            F.min(F.when(F.col("taken") & (F.col("tier") == 1), F.col("head"))).alias("shared"))
        head = (F.when(F.col("is_grace"), F.col("left")).when(F.col("n") == 1, F.col("one"))
                .when((F.col("open") == 0) & (F.col("shared_n") == 1), F.col("shared")))
        done = cut_lineage(picked.select(*keys, "note_id", head.alias("head_id")))
        results = done if results is None else results.unionByName(done)
        taken = done.filter(F.col("head_id").isNotNull()).select(*keys, F.col("head_id").alias("head"))
        used = cut_lineage((taken if used is None else used.unionByName(taken)).distinct())
        rest = cut_lineage(rest.join(done.select(*keys, "note_id"), [*keys, "note_id"], "left_anti"))
    if results is None:
        return notes.withColumn("head_id", F.lit(None).cast(heads.schema["head"].dataType))
    return notes.join(results, [*keys, "note_id"], "left")


def map_regions(measures: DataFrame, regions: DataFrame, keys: Sequence[str], index: str = "measure_index",
                chunk: Column | None = None) -> DataFrame:
    """J-22: the printed region of each measure. ``keys`` names the document.

    Where a system has as many regions as measure slots they meet by slot. Otherwise the measure numbers
    decide, if all are numbers, grow, and span exactly the regions; else the system stays unplaced.
    """
    system = [*keys, "page", "system"]
    m = previous(measures.withColumn("__num", F.col("label").try_cast("bigint")), system, [index], {"__pnum": "__num"}, chunk)
    plain = F.col("label").rlike(r"^\d+$")
    stats = m.groupBy(*system).agg(
        F.countDistinct("slot").alias("__slots"), F.min(plain.cast("int")).alias("__plain"), F.min("__num").alias("__lo"),
        F.max("__num").alias("__hi"), F.count_if(F.col("__num") <= F.col("__pnum")).alias("__back"))
    r = row_index(regions, system, ["region_slot"], "__rank")
    counts = regions.groupBy(*system).agg(F.count(F.lit(1)).alias("__regions"))
    m = m.join(stats, system).join(counts, system, "left").withColumn("__regions", F.coalesce("__regions", F.lit(0)))
    equal = F.col("__regions") == F.col("__slots")
    by_number = (~equal & (F.col("__plain") == 1) & (F.col("__back") == 0)
                 & (F.col("__hi") - F.col("__lo") + 1 == F.col("__regions")))
    place = F.when(equal, F.col("slot")).when(by_number, F.col("__num") - F.col("__lo") + 1)
    m = m.withColumn("__place", place.cast("bigint")).withColumn("__equal", equal)
    slots = r.select(*system, F.col("region_slot").cast("bigint").alias("__place"), F.lit(True).alias("__equal"), F.col("region_id"))
    ranks = r.select(*system, F.col("__rank").cast("bigint").alias("__place"), F.lit(False).alias("__equal"), F.col("region_id"))
    out = m.join(slots.unionByName(ranks), [*system, "__place", "__equal"], "left")
    warn = F.when(~F.col("__equal"), F.when(F.col("region_id").isNotNull(), MISSING_PLACED).otherwise(MISSING_LEFT))
    return (out.withColumn("count_mismatch", ~F.col("__equal")).withColumn("warning", warn)
            .drop("__num", "__pnum", "__slots", "__plain", "__lo", "__hi", "__back", "__regions", "__place", "__equal"))


def system_staff(notes: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-37: each note's staff counted in its system; its own number where the system lacks the part.

    ``regions``: keys, part_roles MAP<STRING, ARRAY<INT>> (0-based staves of each part).
    """
    n = notes.join(regions.select(*keys, "part_roles"), list(keys), "left")
    own = F.coalesce("part_staff", "staff").cast("int")
    roles = F.try_element_at("part_roles", F.col("part_id"))
    role = F.when((own >= 1) & (own <= F.size(roles)), F.get(roles, own - 1))
    system = (role + 1).cast("bigint")
    return (n.withColumn("system_staff", F.coalesce(system, F.col("staff")))
            .withColumn("role", F.greatest(F.lit(0), F.coalesce(system, F.col("staff")) - 1)).drop("part_roles"))


def resolve_pitch(pairs: DataFrame) -> DataFrame:
    """P-15: sounding pitch of matched notes, in order of precedence: the clef the page prints, the score's
    accidental unless the page shows none, and the octave shift the page marks. Columns as in the tests."""
    trusted = (F.col("clef_source") != "pdf") | F.col("head_clef").eqNullSafe(F.col("recognized_clef"))
    alter = F.when(trusted & ~((F.col("head_alter") == 0) & (F.col("alter") != 0)), F.col("alter")).otherwise(F.col("head_alter"))
    source = F.col("pitch") + clef_reference(F.col("clef_sign"), F.col("clef_line"))
    seen = F.floor((source - written_diatonic(F.col("step"), F.col("octave"))) / 7)
    told = F.col("octave_shift") + F.col("clef_octave")
    printed = F.col("pdf_octave_shift")
    shift = F.when(printed.isNotNull(), printed + F.col("clef_octave")).otherwise(seen).cast("int")
    differs = printed.isNull() & (seen != told) & ~F.coalesce("octave_unmarked", F.lit(False))
    return (pairs.withColumn("sounding_alter", alter).withColumn("shift", shift)
            .withColumn("midi", (midi_of_diatonic(F.col("diatonic"), F.col("sounding_alter")) + F.col("shift") * 12
                                 + F.col("transpose")).cast("int"))
            .withColumn("label_diatonic", F.col("diatonic") - F.col("shift") * 7)
            .withColumn("pitch_source", F.when(printed.isNotNull(), "pdf-octave").when(F.col("clef_source") == "pdf", "pdf-clef")
                        .otherwise("matched-omr"))
            .withColumn("warnings", F.array_compact(F.array(F.when(differs, OCTAVE_DISAGREES)))))


# --- recovering what the export left out -----------------------------------------------------------

def restore_deficit(heads: DataFrame, notes: DataFrame, measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-31: heads with a time that the score has too few notes for, as notes.

    ``heads``: source_id, role, onset, midi, voice, cx, used. ``notes``: role, start, midi, voice, duration. Per
    staff and time the surplus of heads is restored: first heads whose pitch no note accounts for, then the
    other free ones, left to right. A restored note lasts as long as its voice's notes there, else to the
    voice's next head, else to the end of the bar.
    """
    group, line = [*keys, "role", "__t"], [*keys, "role", "__head", "__v"]
    h = (heads.filter(F.col("onset").isNotNull()).dropna(subset=[*keys, "role"]).withColumn("__t", tick(F.col("onset"))).withColumn("__v", F.coalesce("voice", F.lit("1")))
         .select(*group, "__v", "midi", F.lit(True).alias("__head"), "source_id", "onset", "cx", "used", F.lit(None).cast(notes.schema["duration"].dataType).alias("__d")))
    empty = {c: F.lit(None).cast(h.schema[c].dataType) for c in ("source_id", "onset", "cx", "used")}
    n = notes.withColumn("__t", tick(F.col("start"))).select(*group, F.col("voice").alias("__v"), "midi", F.lit(False).alias("__head"),
                                                             *[c.alias(k) for k, c in empty.items()], F.col("duration").alias("__d"))

    def over(*by: str) -> WindowSpec:
        return Window.partitionBy(*by)

    # Heads and notes of one staff stand side by side, so what notes say of heads is a window, not a join.
    both = h.unionByName(n)
    both = both.withColumn("__after", F.lead("onset").over(over(*line).orderBy("onset")))
    both = both.withColumn("__next", F.max(F.when(F.col("__after") > F.col("onset"), F.col("__after"))).over(over(*line, "onset")))
    both = both.withColumn("__dur", F.max("__d").over(over(*group, "__v")))
    both = both.withColumn("__known", F.when(F.col("midi").isNotNull(), F.count_if(~F.col("__head")).over(over(*group, "midi"))).otherwise(0))
    both = both.withColumn("__r", F.row_number().over(over(*group, "midi", "__head").orderBy("cx", "source_id")))
    both = both.withColumn("__deficit", (F.count_if("__head").over(over(*group)) - F.count_if(~F.col("__head")).over(over(*group))))
    spare = both.filter(F.col("__head") & (F.col("__deficit") > 0) & ~F.col("used")).withColumn("__rep", (F.col("__r") <= F.col("__known")).cast("int"))
    out = row_index(spare, group, ["__rep", "cx", "source_id"], "__k").filter(F.col("__k") <= F.col("__deficit"))
    out = out.join(measures.select(*keys, F.col("length").alias("__len")), list(keys))
    duration = F.coalesce(F.col("__dur"), F.coalesce("__next", "__len") - F.col("onset"))
    return (out.withColumn("duration", duration).filter(F.col("duration") > TICK)
            .select(*keys, "role", "source_id", F.col("onset").alias("start"), "duration", "midi", F.col("__v").alias("voice")))


def infer_from_aligned(heads: DataFrame, notes: DataFrame, measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-32: free printed heads timed by the notes they line up with.

    ``heads``: source_id, role, cx, w, shape, midi (free ones only). ``notes``: role, cx, start, duration, midi, is_grace.
    A note of the same staff gives start and length; a whole note takes the start of any note and lasts to the
    end of the bar. A pitch already sounding there is not added twice.
    """
    reach = F.greatest(F.col("w") * 0.6, F.lit(1.0))
    spans = heads.select(*keys, "source_id", "shape", F.col("role").alias("h_role"), F.col("midi").alias("h_midi"), F.col("cx").alias("h_cx"), "w")
    near = stab_join(notes.filter("not is_grace").select(*keys, "role", "cx", "start", "duration"), spans, keys, "cx",
                     F.col("h_cx") - reach, F.col("h_cx") + reach, 16.0, closed_right=True)
    own = F.col("role") == F.col("h_role")
    ident = [*keys, "source_id", "shape", "h_role", "h_midi", "h_cx"]
    best = near.groupBy(*ident).agg(F.min(F.when(own, F.struct("start", "duration"))).alias("__own"), F.min("start").alias("__any"))
    m = best.join(measures.select(*keys, "length"), list(keys))
    whole = F.col("shape") == "WHOLE_NOTE"
    start = F.coalesce("__own.start", F.when(whole, F.col("__any")))
    duration = F.coalesce("__own.duration", F.when(whole, F.col("length") - F.col("__any")))
    timed = m.withColumn("start", start).withColumn("duration", duration).filter(F.col("duration") > TICK)
    timed = timed.withColumn("__t", tick(F.col("start")))
    taken = notes.select(*keys, F.col("role").alias("h_role"), F.col("midi").alias("h_midi"), tick(F.col("start")).alias("__t"))
    fresh = timed.join(taken, [*keys, "h_role", "h_midi", "__t"], "left_anti")
    row = F.struct("source_id", "start", "duration", F.when(F.col("__own").isNotNull(), "aligned-chord").otherwise("aligned-whole-note").alias("timing"))
    first = fresh.groupBy(*keys, "h_role", "h_midi", "__t").agg(F.min_by(row, F.struct("h_cx", "source_id")).alias("r"))
    return first.select(*keys, F.col("h_role").alias("role"), F.col("h_midi").alias("midi"), "r.*")


def uniform_runs(heads: DataFrame, notes: DataFrame, measures: DataFrame, rests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """W-08: a bar of one staff whose heads stand evenly and are one more than its equal notes: every head
    gets its place in the row.

    ``heads``: source_id, role, cx, confidence, uncertain, shape, vector. ``notes``: head_id, role, start, duration, voice,
    irregular (grace, chord, tied or unmatched). Returns source_id, start, duration, recovered for accepted bars.
    """
    line = [*keys, "role"]
    n = notes.groupBy(*line).agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.col("irregular").cast("int")).alias("__odd"), F.min("voice").alias("__v0"), F.max("voice").alias("__v1"),
        F.min(F.round("duration", 8)).alias("__d"), F.max(F.round("duration", 8)).alias("__d1"))
    matched = notes.select(*keys, "role", F.col("head_id").alias("source_id"), F.col("start").alias("__start")).filter("source_id is not null")
    h = heads.join(matched, [*line, "source_id"], "left")
    h = row_index(h, line, ["cx", "source_id"], "__i")
    h = previous(h, line, ["cx", "source_id"], {"__pcx": "cx", "__pstart": "__start"})
    h = h.withColumn("gap", F.col("cx") - F.col("__pcx"))
    missing = F.col("__start").isNull()
    s = h.groupBy(*line).agg(
        F.count(F.lit(1)).alias("__h"), F.count_if(missing).alias("__m"), F.count_if(missing & ~F.col("vector")).alias("__mv"),
        F.count_if((F.col("confidence") < 0.8) | F.col("uncertain") | (F.col("shape") != "NOTEHEAD_BLACK")).alias("__weak"),
        F.min("gap").alias("__g0"), F.max("gap").alias("__g1"))
    mid = upper_median(h.filter(F.col("gap").isNotNull()), "gap", line, "__g")
    g = s.join(n, line).join(mid, line).join(measures.select(*keys, "length"), list(keys)).join(rests.select(*line).distinct(), line, "left_anti")
    expected = F.when(F.col("__d") > 0, F.rint(F.col("length") / F.col("__d"))).otherwise(0)
    even = (F.col("__g") > 0) & (F.col("__g1") - F.col("__g") <= F.col("__g") * 0.18) & (F.col("__g") - F.col("__g0") <= F.col("__g") * 0.18)
    ok = ((F.col("__n") >= 3) & (F.col("__m") > 0) & (F.col("__mv") == 0) & (F.col("__odd") == 0) & (F.col("__v0") == F.col("__v1"))
          & (F.col("__d") == F.col("__d1")) & (expected > 0) & (F.abs(expected * F.col("__d") - F.col("length")) <= TICK)
          & (F.col("__h") == expected) & (F.col("__n") + F.col("__m") == expected) & (F.col("__weak") == 0) & even)
    # The notes must stand in head order and be compressed to the front of the bar.
    known = row_index(h.filter("__start is not null"), line, ["cx", "source_id"], "__k").join(g.filter(ok).select(*line, "__d"), line)
    wrong = known.filter(F.abs(F.col("__start") - (F.col("__k") - 1) * F.col("__d")) > TICK).select(*line).distinct()
    good = g.filter(ok).select(*line, "__d").join(wrong, line, "left_anti")
    return h.join(good, line).select(*line, "source_id", ((F.col("__i") - 1) * F.col("__d")).alias("start"), F.col("__d").alias("duration"),
                                     missing.alias("recovered"))


def extend_tail(heads: DataFrame, notes: DataFrame, measures: DataFrame, rests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """W-09: heads at the end of a bar continue its last three equal, evenly spaced notes, if they complete it
    exactly.

    ``heads``: source_id, role, cx, chord_id, onset, voice, confidence, uncertain, shape, used. ``notes``: head_id, role,
    start, duration, voice, irregular (grace or tied). ``rests``: role, start, duration.
    """
    line = [*keys, "role"]
    placed = notes.join(heads.select(*keys, F.col("source_id").alias("head_id"), F.col("cx").alias("__cx")), [*keys, "head_id"])
    onsets = placed.groupBy(*line, "start").agg(
        F.min("duration").alias("d0"), F.max("duration").alias("d1"), F.min("voice").alias("v0"), F.max("voice").alias("v1"),
        F.max(F.col("irregular").cast("int")).alias("odd"), F.avg("__cx").alias("x"))
    last = top_n_per_key(onsets, line, [F.col("start").desc()], 3, "__r")

    def at(i: int, c: str) -> Column:
        return F.max(F.when(F.col("__r") == i, F.col(c))).alias(f"__{c}{i}")

    a = last.groupBy(*line).agg(F.count(F.lit(1)).alias("__n"), F.max("odd").alias("__odd"), F.min("d0").alias("__d"), F.max("d1").alias("__d1"),
                                F.min("v0").alias("__v"), F.max("v1").alias("__v1"), *[at(i, c) for i in (1, 2, 3) for c in ("start", "x")])
    space = (F.col("__x1") - F.col("__x3")) / 2
    steady = ((F.col("__n") == 3) & (F.col("__odd") == 0) & (F.col("__d") > 0) & (F.col("__d1") - F.col("__d") <= TICK) & (F.col("__v") == F.col("__v1"))
              & (F.abs(F.col("__start1") - F.col("__start2") - F.col("__d")) <= TICK) & (F.abs(F.col("__start2") - F.col("__start3") - F.col("__d")) <= TICK)
              & (space > 0) & (F.abs(F.col("__x2") - F.col("__x3") - space) <= space * 0.15))
    a = a.filter(steady).select(*line, "__d", "__v", F.col("__x1"), space.alias("__space"), (F.col("__start1") + F.col("__d")).alias("__end"))
    # Nothing may start or sound where the tail would stand.
    starts = notes.groupBy(*line).agg(F.max("start").alias("__s"))
    ends = rests.groupBy(*line).agg(F.max(F.col("start") + F.col("duration")).alias("__x"))
    a = (a.join(measures.select(*keys, "length"), list(keys)).join(starts, line, "left").join(ends, line, "left")
         .filter(~F.coalesce((F.col("__s") >= F.col("__end")) | (F.col("__x") > F.col("__end")), F.lit(False))))
    tail = heads.filter(~F.col("used")).join(a, line).filter(F.col("cx") > F.col("__x1")).withColumn("__chord", F.coalesce("chord_id", "source_id"))
    whole = Window.partitionBy(*line)
    t = tail.withColumn("__first", F.min("cx").over(Window.partitionBy(*line, "__chord")))
    t = t.withColumn("__g", F.dense_rank().over(whole.orderBy("__first", "__chord")).cast("bigint"))
    bad = (F.col("onset").isNotNull() | F.col("voice").isNotNull() | (F.coalesce("confidence", F.lit(0.0)) < 0.8) | F.col("uncertain")
           | (F.col("shape") != "NOTEHEAD_BLACK") | (F.abs(F.col("cx") - F.col("__x1") - F.col("__g") * F.col("__space")) > F.col("__space") * 0.2))
    t = t.withColumns({"__count": F.max("__g").over(whole), "__bad": F.max(bad.cast("int")).over(whole)})
    return (t.filter((F.col("__bad") == 0) & (F.abs(F.col("__end") + F.col("__count") * F.col("__d") - F.col("length")) <= TICK))
            .select(*line, "source_id", (F.col("__end") + (F.col("__g") - 1) * F.col("__d")).alias("start"), F.col("__d").alias("duration"), F.col("__v").alias("voice")))


def mark_groups(notes: DataFrame, signs: DataFrame, keys: Sequence[str], page: Sequence[str]) -> DataFrame:
    """J-30: chords rolled because any of their notes stands against an arpeggio sign.

    ``keys`` names the measure, ``page`` the page columns. ``notes``: note_id, part, start, arpeggiate and a box.
    Chords already marked whole are left; ``rolled`` tells the newly marked notes.
    """
    boxed = notes.filter(F.col("x0").isNotNull())
    h = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    spans = boxed.select(*page, *[k for k in keys if k not in page], "note_id", "x0", "y0", "y1")
    hit = stab_join(signs.select(*page, "sx", "top", "bottom"), spans, page, "sx", F.col("x0") - h * 2.5, F.col("x0") + h * 0.2, 32.0, closed_right=True)
    mid = (F.col("y0") + F.col("y1")) / 2
    touched = hit.filter((mid >= F.col("top") - h * 1.5) & (mid <= F.col("bottom") + h * 1.5)).select(*keys, "note_id").distinct()
    n = notes.join(touched.withColumn("__hit", F.lit(True)), [*keys, "note_id"], "left").withColumn("__t", F.round("start", 6))
    chord = [*keys, "part", "__t"]
    flags = n.groupBy(*chord).agg(F.max(F.coalesce("__hit", F.lit(False)).cast("int")).alias("__any"), F.min(F.col("arpeggiate").cast("int")).alias("__all"))
    rolled = (F.col("__any") == 1) & (F.col("__all") == 0)
    return (n.join(flags, chord).withColumn("rolled", rolled).withColumn("arpeggiate", F.col("arpeggiate") | rolled)
            .drop("__hit", "__t", "__any", "__all"))


# --- fallbacks, statistics, overrides --------------------------------------------------------------

def score_only_fallback(notes: DataFrame, measures: DataFrame, docs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """P-18: documents whose geometry failed (``docs``) play from the score alone: no positions, one warning per bar."""
    failed = docs.select(*keys).distinct().withColumn("__f", F.lit(True))
    n = notes.join(failed, list(keys), "left")
    f = F.coalesce("__f", F.lit(False))
    n = n.withColumns({"head_id": F.when(~f, F.col("head_id")), "confidence": F.when(~f, F.col("confidence")),
                       "midi": F.when(f, F.col("xml_midi")).otherwise(F.col("midi")),
                       "pitch_source": F.when(f, "musicxml-only").otherwise(F.col("pitch_source"))}).drop("__f")
    m = measures.join(failed, list(keys), "left")
    m = m.withColumn("warnings", F.when(f, F.concat("warnings", F.array(F.lit(FAILED)))).otherwise(F.col("warnings"))).drop("__f")
    return n, m


def alignment_stats(notes: DataFrame, measures: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-14: per document, notes matched and not, corrections, recoveries by source, bars without positions,
    systems that disagree, and read pages without a region.

    ``notes``: measure_index, head_id, midi, xml_midi, pitch_source. ``measures``: count_mismatch. ``pages``: read, regions.
    """
    recovered = F.startswith(F.col("pitch_source"), F.lit("pdf-vector-recovered"))
    onset = F.col("pitch_source") == "omr-recovered-onset"
    tail = F.col("pitch_source") == "omr-recovered-tail"
    found = recovered | onset | tail
    bars = notes.groupBy(*keys, "measure_index").agg(
        F.count_if(F.col("head_id").isNotNull() & ~found).alias("m"), F.count_if(F.col("head_id").isNull()).alias("u"),
        F.count_if(F.col("head_id").isNotNull() & ~found & (F.col("midi") != F.col("xml_midi"))).alias("c"),
        F.count_if(recovered).alias("v"), F.count_if(onset).alias("o"), F.count_if(found).alias("r"))
    n = bars.groupBy(*keys).agg(F.sum("m").alias("notes_matched"), F.sum("u").alias("notes_unmatched"), F.sum("c").alias("pitch_corrections"),
                                F.sum("v").alias("notes_recovered_from_vector_pdf"), F.sum("o").alias("notes_recovered_from_omr_onsets"),
                                F.sum("r").alias("notes_recovered"), F.count_if(F.col("u") > 0).alias("measures_without_note_positions"))
    m = measures.groupBy(*keys).agg(F.count_if("count_mismatch").alias("measure_count_mismatch"))
    p = pages.groupBy(*keys).agg(F.count_if(F.col("read") & (F.coalesce("regions", F.lit(0)) == 0)).alias("pages_without_regions"))
    joined = n.join(m, list(keys), "full").join(p, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in joined.columns if c not in keys])


def apply_page_overrides(book: DataFrame, overrides: DataFrame, keys: Sequence[str], index: str = "measure_index") -> DataFrame:
    """S-11: measures of a re-read page replace the book's. The book's labels stay where both count the same bars."""
    page = [*keys, "page"]
    redone = overrides.select(*page).distinct()
    ours = row_index(book.join(redone, page, "left_semi"), page, [index], "__k").select(*page, "__k", F.col("label").alias("__label"))
    size = ours.groupBy(*page).agg(F.count(F.lit(1)).alias("__a"))
    theirs = row_index(overrides, page, [index], "__k")
    count = overrides.groupBy(*page).agg(F.count(F.lit(1)).alias("__b"))
    new = theirs.join(count, page).join(size, page, "left").join(ours, [*page, "__k"], "left")
    new = new.withColumn("label", F.when(F.col("__a") == F.col("__b"), F.col("__label")).otherwise(F.col("label"))).select(*overrides.columns)
    return book.join(redone, page, "left_anti").select(*overrides.columns).unionByName(new)
