"""From printed measures and notes to the performed timeline.

``keys`` names the document; beats are quarter notes from the start. ``chunk_width`` (beats) cuts long
documents into stretches; None runs a document in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.functions.pitch import LETTERS, display_text, key_alter, midi_of_letter
from quaverlake.operators.asof import asof_join, asof_next
from quaverlake.operators.bands import stab_join
from quaverlake.operators.segments import (carry_last, carry_next, islands, previous, row_index, running_sum, settle,
                                           with_totals)
from quaverlake.session import cut_lineage

# Expression defaults and articulation effects.
DEFAULT_DYNAMIC, DEFAULT_TEMPO, MAX_BPM = 80.0, 96.0, 300.0
ACCENTS = {"strong-accent": 18, "accent": 10}
SHORTENING = {"staccatissimo": 0.25, "staccato": 0.5, "detached-legato": 0.85}
PEDAL_DOWN = ("start", "sostenuto", "change", "continue", "resume")
PEDAL_UP = ("stop", "change", "discontinue")
ORNAMENTS = ("trill-mark", "mordent", "inverted-mordent", "turn", "inverted-turn")
EPS, STEP = 1e-8, 1e-6
GRACE_SHARE, GRACE_CAP = 0.25, 0.25
GRACE_SHOWN = 0.25
FERMATA_SHARE, FERMATA_LEAST, FERMATA_MOST = 0.5, 0.5, 2.0


def _chunk(col: str, width: float | None) -> Column | None:
    return None if width is None else F.floor(F.col(col) / F.lit(width)).cast("bigint")


# --- positions ---------------------------------------------------------------------------------

def start_beats(order: DataFrame, keys: Sequence[str], position: str = "position", length: str = "length",
                chunk_rows: int | None = None) -> DataFrame:
    """W-05: where each played measure starts: the sum of the lengths before it."""
    return running_sum(order, keys, [position], F.col(length), "start_beat", _chunk(position, chunk_rows), inclusive=False)


def distinct_midis(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-36: sorted distinct pitches of each measure (128 at most)."""
    return notes.groupBy(*keys).agg(F.array_sort(F.collect_set("midi")).alias("distinct_midis"))


def note_order(notes: DataFrame, keys: Sequence[str], order: Sequence[str] = ("start_beat", "midi", "source_id"),
               chunk: Column | None = None) -> DataFrame:
    """T-04: notes in canonical order as a 0-based ``seq`` column."""
    return row_index(notes, keys, order, "__n", chunk).withColumn("seq", F.col("__n") - 1).drop("__n")


def stagger(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """W-10: the notes of a rolled chord enter one by one from the lowest, at most 30 % of their length late."""
    marked, rest = notes.filter("arpeggiate"), notes.filter("not arpeggiate")
    ranked = row_index(marked, [*keys, "part", "start_beat"], ["midi", "source_id"], "__i",
                       F.floor(F.col("midi") / 12).cast("bigint"))
    late = F.least(0.08 * (F.col("__i") - 1), F.col("duration") * 0.3)
    moved = (ranked.withColumn("__late", late).withColumn("start_beat", F.col("start_beat") + F.col("__late"))
             .withColumn("duration", F.col("duration") - F.col("__late")).drop("__i", "__late"))
    return moved.unionByName(rest)


# --- loudness and sounding length ----------------------------------------------------------------

def velocity(notes: DataFrame, dynamics: DataFrame, keys: Sequence[str], chunk_width: float | None = None) -> DataFrame:
    """W-11: the dynamic in force (80 by default) plus accents, 1 to 127; key time by articulation."""
    marks = dynamics.select(*keys, "part", "staff", (F.col("start_beat") - EPS).alias("start_beat"), F.col("seq").alias("__seq"),
                            F.col("value").cast("double").alias("__dyn"))
    n = asof_join(notes, marks, [*keys, "part", "staff"], "start_beat", ["__dyn"], seq="__seq",
                  defaults={"__dyn": DEFAULT_DYNAMIC}, chunk_width=chunk_width)
    arts = F.col("articulations")
    extra, factor = F.lit(0), F.lit(1.0)
    for name, add in reversed(ACCENTS.items()):
        extra = F.when(F.array_contains(arts, name), add).otherwise(extra)
    for name, by in reversed(SHORTENING.items()):
        factor = F.when(F.array_contains(arts, name), by).otherwise(factor)
    return (n.withColumn("velocity", F.least(F.lit(127.0), F.greatest(F.lit(1.0), F.col("__dyn") + extra)))
            .withColumn("key_duration", F.col("duration") * F.when(F.col("tie_start"), 1.0).otherwise(factor)).drop("__dyn"))


def ramps(wedges: DataFrame, dynamics: DataFrame, notes: DataFrame, keys: Sequence[str],
          chunk_width: float | None = None) -> DataFrame:
    """W-15: a dynamic row for each note under a wedge, on the line from the level at its start to the dynamic printed at its end
    (16 louder or softer where none is).

    Wedges of a part and staff take effect in the order of their ends. The level at a wedge's start is what the last wedge before it in that
    order had reached by then, if that one holds notes that early; else the last printed dynamic, 80 without any. Wedges of one ``number``
    follow each other, those of different numbers may overlap. A wedge without notes leaves nothing; equal ends go by ``seq``.
    """
    line = [*keys, "part", "staff"]
    wedges = wedges.filter(F.col("value").isin("crescendo", "diminuendo", "stop"))
    w = previous(wedges, [*line, "number"], ["start_beat", "seq"], {"__kind": "value", "from_beat": "start_beat"},
                 _chunk("start_beat", chunk_width))
    pairs = w.filter((F.col("value") == "stop") & F.col("__kind").isin("crescendo", "diminuendo")
                     & (F.col("start_beat") > F.col("from_beat"))).withColumnRenamed("start_beat", "to_beat")
    pairs = settle(pairs, _chunk("to_beat", chunk_width))
    pairs = cut_lineage(row_index(pairs, line, ["to_beat", "seq", "number"], "__rank", _chunk("to_beat", chunk_width)))
    hit = cut_lineage(stab_join(notes.select(*line, "source_id", "start_beat"), pairs.select(*line, "__rank", "from_beat", "to_beat"), line,
                                "start_beat", F.col("from_beat"), F.col("to_beat"), chunk_width or 64.0))
    pairs = pairs.join(hit.groupBy(*line, "__rank").agg(F.min("start_beat").alias("__first")), [*line, "__rank"])
    levels = _wedge_levels(pairs, dynamics, hit, line, chunk_width)
    share = (F.col("start_beat") - F.col("from_beat")) / (F.col("to_beat") - F.col("from_beat"))
    return (hit.join(levels, [*line, "__rank"])
            .select(*line, "source_id", "start_beat", (F.col("__level") + (F.col("__goal") - F.col("__level")) * share).alias("value")))


def _wedge_levels(pairs: DataFrame, dynamics: DataFrame, hit: DataFrame, line: Sequence[str], chunk_width: float | None) -> DataFrame:
    """Level and goal of each wedge.

    A wedge's level is a linear function of the level of the wedge it follows; functions of ever longer stretches of a chain are
    composed, so the rounds grow with the logarithm of the longest chain.
    """
    marks = dynamics.select(*line, F.col("start_beat").alias("from_beat"), F.col("seq").alias("__seq"), F.col("value").cast("double").alias("__printed"))
    at_end = (dynamics.groupBy(*line, F.rint(F.col("start_beat") / STEP).cast("bigint").alias("__k"))
              .agg(F.min_by(F.col("value").cast("double"), F.struct("start_beat", "seq")).alias("__target")))
    spans = asof_join(pairs.select(*line, "number", "__rank", "from_beat", "to_beat", "__first", F.col("__kind").alias("kind")), marks, line, "from_beat",
                      ["__printed"], seq="__seq", defaults={"__printed": DEFAULT_DYNAMIC}, chunk_width=chunk_width)
    spans = cut_lineage(spans.withColumn("__k", F.rint(F.col("to_beat") / STEP).cast("bigint")).join(at_end, [*line, "__k"], "left").drop("__k"))

    # Of each number, the last wedge with notes by this one's start; if that ends later than this one, the one before it.
    lanes = previous(spans, [*line, "number"], ["__rank"], {"__before": "__rank"}, _chunk("to_beat", chunk_width))
    asks = spans.select(*line, "__rank", "from_beat").join(spans.select(*line, "number").distinct(), list(line))
    found = asof_join(asks, lanes.select(*line, "number", F.col("__first").alias("from_beat"), F.col("__rank").alias("__near"), "__before"),
                      [*line, "number"], "from_beat", ["__near", "__before"], chunk_width=chunk_width)
    after = (found.groupBy(*line, "__rank", "from_beat").agg(F.max(F.when(F.col("__near") < F.col("__rank"), F.col("__near")).otherwise(F.col("__before"))).alias("__up"))
             .filter(F.col("__up").isNotNull()))
    after = asof_join(after, hit.select(*line, F.col("__rank").alias("__up"), F.col("start_beat").alias("from_beat"), F.col("start_beat").alias("__at")),
                      [*line, "__up"], "from_beat", ["__at"], chunk_width=chunk_width)

    change = F.when(F.col("kind") == "crescendo", 16.0).otherwise(-16.0)
    upper = spans.select(*line, F.col("__rank").alias("__up"), F.col("from_beat").alias("__f"), F.col("to_beat").alias("__t"), "__target", change.alias("__change"))
    share = (F.col("__at") - F.col("__f")) / (F.col("__t") - F.col("__f"))
    links = after.join(upper, [*line, "__up"]).select(
        *line, "__rank", "__up", F.when(F.col("__target").isNull(), 1.0).otherwise(1.0 - share).alias("__a"), (F.coalesce("__target", "__change") * share).alias("__b"))
    chain = cut_lineage(spans.join(links, [*line, "__rank"], "left").select(
        *line, "__rank", "__up", F.coalesce("__a", F.lit(0.0)).alias("__a"), F.when(F.col("__up").isNull(), F.col("__printed")).otherwise(F.col("__b")).alias("__b")))
    while not chain.filter(F.col("__up").isNotNull()).isEmpty():
        before = chain.select(*line, F.col("__rank").alias("__up"), F.col("__up").alias("__up2"), F.col("__a").alias("__a2"), F.col("__b").alias("__b2"))
        chain = cut_lineage(chain.join(before, [*line, "__up"], "left").select(
            *line, "__rank", F.col("__up2").alias("__up"), F.when(F.col("__up").isNull(), F.col("__a")).otherwise(F.col("__a") * F.col("__a2")).alias("__a"),
            F.when(F.col("__up").isNull(), F.col("__b")).otherwise(F.col("__a") * F.col("__b2") + F.col("__b")).alias("__b")))
    return (spans.join(chain.select(*line, "__rank", F.col("__b").alias("__level")), [*line, "__rank"])
            .select(*line, "__rank", "__level", F.coalesce("__target", F.col("__level") + change).alias("__goal")))


# --- sounding events -----------------------------------------------------------------------------

def _in_order(order: Column, value: str) -> Column:
    """The values of a group's few rows as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def merge_ties(notes: DataFrame, keys: Sequence[str], chunk_width: float | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """W-12: tied segments of one (part, voice, pitch) that touch are one sounding event.

    The event has the first segment's start, pitch and ``carried`` columns, names its segments in order (``segment_ids``), and ends
    with its last one. A stop without an adjacent start begins its own event and is flagged ``orphan_stop``.
    """
    line = [*keys, "part", "voice", "midi"]
    order, chunk = ["start_beat", "source_id"], _chunk("start_beat", chunk_width)
    end = F.col("start_beat") + F.col("duration")
    n = previous(notes.withColumn("__end", end), line, order, {"__pend": "__end", "__ptie": "tie_start"}, chunk)
    joined = (F.col("tie_stop") & F.coalesce(F.col("__ptie"), F.lit(False))
              & (F.abs(F.col("__pend") - F.col("start_beat")) < STEP))
    n = settle(n.withColumn("__joined", F.coalesce(joined, F.lit(False))), chunk)
    n = islands(n, line, order, ~F.col("__joined"), "__event", chunk)
    first, last = F.struct(*order), F.struct(*order)
    return n.groupBy(*line, "__event").agg(
        F.min("start_beat").alias("start_beat"),
        (F.max_by(F.col("start_beat") + F.col("key_duration"), last) - F.min("start_beat")).alias("duration"),
        F.min_by("source_id", first).alias("source_id"), F.min_by("velocity", first).alias("velocity"),
        *[F.min_by(c, first).alias(c) for c in carried], _in_order(F.struct(*order), "source_id").alias("segment_ids"),
        F.count(F.lit(1)).alias("segments"), F.bool_or(F.col("tie_stop") & ~F.col("__joined")).alias("orphan_stop")).drop("__event")


def collapse_strikes(notes: DataFrame, keys: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """W-13: a key two voices strike together sounds once, as long and as loud as the longest and loudest.

    The event has the ``carried`` columns of the first voice and names all its notes (``segment_ids``).
    """
    first = F.struct("voice", "source_id")
    return notes.groupBy(*keys, "part", "midi", F.round("start_beat", 6).alias("__at")).agg(
        F.min("start_beat").alias("start_beat"), F.max("key_duration").alias("duration"), F.max("velocity").alias("velocity"),
        F.min_by("source_id", first).alias("source_id"), *[F.min_by(c, first).alias(c) for c in carried],
        _in_order(first, "source_id").alias("segment_ids"), F.count(F.lit(1)).alias("strikes")).drop("__at")


def sounding_events(notes: DataFrame, keys: Sequence[str], chunk_width: float | None = None, carried: Sequence[str] = ("role",)) -> DataFrame:
    """W-12, W-13 and what follows from both: every written note in exactly one sounding event, named by its first note.

    Tied notes sound as one; plain notes (neither tied nor grace) that two voices strike together sound once, at the start of the
    first of them. ``segment_ids`` are what ``correct_audio`` looks up.
    """
    tied = F.col("tie_start") | F.col("tie_stop")
    plain = ~tied & ~F.col("is_grace") if "is_grace" in notes.columns else ~tied
    merged = merge_ties(notes.withColumn("__plain", plain), keys, chunk_width, [*carried, "__plain"])
    first = F.struct("voice", "source_id")
    alone = [F.when(~F.col("__plain"), F.col(c)).alias(f"__{c}") for c in ("voice", "source_id")]
    return (merged.groupBy(*keys, "part", "midi", F.round("start_beat", 6).alias("__at"), *alone).agg(
        F.min("start_beat").alias("start_beat"), F.max("duration").alias("duration"), F.max("velocity").alias("velocity"),
        F.min_by("source_id", first).alias("source_id"), *[F.min_by(c, first).alias(c) for c in carried],
        F.flatten(_in_order(first, "segment_ids")).alias("segment_ids"), F.bool_or("orphan_stop").alias("orphan_stop"))
            .drop("__at", "__voice", "__source_id"))


def apply_pedal(audio: DataFrame, pedals: DataFrame, totals: DataFrame, keys: Sequence[str],
                chunk_width: float | None = None) -> DataFrame:
    """W-14: a note that ends under a held pedal sounds to the next release, at most to the end (``total_beats``)."""
    line = [*keys, "part"]
    a = audio.withColumn("__end", F.col("start_beat") + F.col("duration"))
    state = pedals.select(*line, (F.col("start_beat") - EPS).alias("__end"), F.col("seq").alias("__seq"),
                          F.col("value").isin(*PEDAL_DOWN).alias("__down"))
    a = settle(asof_join(a, state, line, "__end", ["__down"], seq="__seq", chunk_width=chunk_width), _chunk("__end", chunk_width))
    up = pedals.filter(F.col("value").isin(*PEDAL_UP)).select(
        *line, (F.col("start_beat") - EPS).alias("__end"), F.col("seq").alias("__seq"), F.col("start_beat").alias("__release"))
    a = asof_next(a, up, line, "__end", ["__release"], seq="__seq", chunk_width=chunk_width)
    a = a.join(totals.select(*keys, F.col("total_beats").alias("__total")), list(keys), "left")
    end = F.when(F.coalesce("__down", F.lit(False)), F.coalesce("__release", "__total")).otherwise(F.col("__end"))
    return (a.withColumn("duration", F.greatest(F.lit(0.0), F.least("__total", end) - F.col("start_beat")))
            .drop("__end", "__down", "__release", "__total"))


def neighbor_midi(step: Column, octave: Column, fifths: Column, transpose: Column, midi: Column, xml_midi: Column,
                  direction: int) -> Column:
    """F-18: the diatonic neighbour of a note in its key, as sounded."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    i = F.array_position(letters, step) - 1 + direction
    near = F.get(letters, F.pmod(i, F.lit(7)).cast("int"))
    other = octave + F.when(i >= 7, 1).when(i < 0, -1).otherwise(0)
    written = midi_of_letter(near, other, key_alter(near, fifths)) + transpose
    return midi + written - xml_midi


def expand_ornaments(notes: DataFrame, most_strokes: int) -> DataFrame:
    """F-18: ornamented notes as their alternating neighbours, then the rest of the note.

    ``notes``: source_id, ornaments, tie flags, start_beat, key_duration, midi, xml_midi, step, octave,
    key_fifths, transpose. Notes tied or shorter than an eighth of a beat stay plain. Adds ``part_of`` (0 plain). A trill
    has two to ``most_strokes`` strokes.
    """
    up, low = (neighbor_midi(F.col("step"), F.col("octave"), F.coalesce("key_fifths", F.lit(0)), F.coalesce("transpose", F.lit(0)),
                             F.col("midi"), F.col("xml_midi"), s) for s in (1, -1))
    known = F.get(F.filter("ornaments", lambda o: o.isin(*ORNAMENTS)), F.lit(0))
    n = notes.withColumn("__o", F.when(~F.col("tie_start") & ~F.col("tie_stop") & (F.col("key_duration") >= 0.125), known))
    n = n.withColumn("__up", up.cast("int")).withColumn("__low", low.cast("int")).withColumn("__m", F.col("midi").cast("int"))
    count = F.greatest(F.lit(2), F.least(F.lit(most_strokes), F.rint(F.col("key_duration") / 0.125).cast("int")))
    trill = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(i % 2 == 0, F.col("__m")).otherwise(F.col("__up")))
    shapes = (F.when(F.col("__o") == "trill-mark", trill)
              .when(F.col("__o") == "mordent", F.array("__m", "__up", "__m"))
              .when(F.col("__o") == "inverted-mordent", F.array("__m", "__low", "__m"))
              .when(F.col("__o") == "turn", F.array("__up", "__m", "__low", "__m"))
              .when(F.col("__o") == "inverted-turn", F.array("__low", "__m", "__up", "__m")))
    n = n.withColumn("__p", shapes)
    size = F.size("__p")
    unit = F.when(F.col("__o") == "trill-mark", F.col("key_duration") / size).otherwise(
        F.least(F.lit(0.125), F.col("key_duration") / size))
    n = n.withColumn("__u", F.when(F.col("__p").isNotNull(), unit))
    event = "struct<part_of: int, midi: int, start_beat: double, duration: double>"
    tail = F.col("key_duration") - F.col("__u") * size
    parts = F.transform("__p", lambda p, i: F.struct((i + 1).alias("part_of"), p.alias("midi"),
                                                     (F.col("start_beat") + i * F.col("__u")).alias("start_beat"),
                                                     (F.col("__u") * 0.9).alias("duration")).cast(event))
    rest = F.when(tail > 0, F.array(F.struct((size + 1).alias("part_of"), F.col("__m").alias("midi"),
                                             (F.col("start_beat") + F.col("__u") * size).alias("start_beat"),
                                             tail.alias("duration")).cast(event))).otherwise(F.array().cast(f"array<{event}>"))
    plain = F.array(F.struct(F.lit(0).alias("part_of"), F.col("__m").alias("midi"), F.col("start_beat").alias("start_beat"),
                             F.col("key_duration").alias("duration")).cast(event))
    out = n.withColumn("__e", F.explode(F.when(F.col("__p").isNull(), plain).otherwise(F.concat(parts, rest))))
    keep = [c for c in notes.columns if c not in ("midi", "start_beat", "duration")]
    return out.select(*keep, "__e.*")


# --- tempo -----------------------------------------------------------------------------------------

def tempo_map(events: DataFrame, docs: DataFrame, keys: Sequence[str], default_bpm: float = DEFAULT_TEMPO) -> DataFrame:
    """W-16: one tempo per position, the last written wins; a default opens documents without one at 0."""
    opening = docs.select(*keys, F.lit(0.0).alias("start_beat"), F.lit(default_bpm).alias("bpm"),
                          F.lit(1.0).alias("beat_unit_quarters"), F.lit(-1).cast("bigint").alias("seq")).distinct()
    rows = events.select(*keys, F.col("start_beat").cast("double"), F.col("value").cast("double").alias("bpm"),
                         F.coalesce("beat_unit_quarters", F.lit(1.0)).cast("double").alias("beat_unit_quarters"),
                         F.col("seq").cast("bigint"))
    last = (opening.unionByName(rows).groupBy(*keys, "start_beat")
            .agg(F.max_by(F.struct("bpm", "beat_unit_quarters"), F.col("seq")).alias("__t")))
    return last.select(*keys, "start_beat", "__t.*")


def tempo_clock(tempo: DataFrame, keys: Sequence[str], speed: float = 1.0, base_bpm: float | None = None,
                chunk_width: float | None = None) -> DataFrame:
    """W-17: seconds at each tempo position and seconds per beat after it.

    The speed gives way where the fastest tempo would pass 300 BPM; ``base_bpm`` rescales all tempi so
    the first one has it.
    """
    t = tempo.filter(F.col("bpm") > 0)
    t = with_totals(t, keys, __fast=F.max("bpm"), __open=F.min_by("bpm", "start_beat"))
    scale = F.lit(1.0) if not base_bpm or base_bpm <= 0 else F.lit(float(base_bpm)) / F.col("__open")
    rate = F.least(F.lit(speed if speed > 0 else 1.0), F.lit(MAX_BPM) / (F.col("__fast") * scale))
    t = t.withColumn("seconds_per_beat", 60 / (F.col("bpm") * scale * rate))
    chunk = _chunk("start_beat", chunk_width)
    t = settle(previous(settle(t, chunk), keys, ["start_beat"], {"__pb": "start_beat", "__ps": "seconds_per_beat"}, chunk), chunk)
    spent = F.coalesce((F.col("start_beat") - F.col("__pb")) * F.col("__ps"), F.lit(0.0))
    t = running_sum(t, keys, ["start_beat"], spent, "seconds", chunk)
    return settle(t.drop("__fast", "__open", "__pb", "__ps"), chunk)


def seconds_at(points: DataFrame, clock: DataFrame, keys: Sequence[str], beat: str = "beat",
               chunk_width: float | None = None) -> DataFrame:
    """W-17: seconds of beat positions."""
    c = clock.select(*keys, F.col("start_beat").alias(beat), F.col("start_beat").alias("__b"), F.col("seconds").alias("__s"),
                     F.col("seconds_per_beat").alias("__spb"))
    at = asof_join(points, c, keys, beat, ["__b", "__s", "__spb"], chunk_width=chunk_width)
    return at.withColumn("seconds", F.col("__s") + (F.col(beat) - F.col("__b")) * F.col("__spb")).drop("__b", "__s", "__spb")


def beat_at(points: DataFrame, clock: DataFrame, keys: Sequence[str], seconds: str = "seconds",
            chunk_width: float | None = None) -> DataFrame:
    """W-17: beat positions of seconds."""
    c = clock.select(*keys, F.col("seconds").alias(seconds), F.col("start_beat").alias("__b"), F.col("seconds").alias("__s"),
                     F.col("seconds_per_beat").alias("__spb"))
    at = asof_join(points, c, keys, seconds, ["__b", "__s", "__spb"], chunk_width=chunk_width)
    return at.withColumn("beat", F.col("__b") + (F.col(seconds) - F.col("__s")) / F.col("__spb")).drop("__b", "__s", "__spb")


# --- reading a timeline --------------------------------------------------------------------------

def shown_duration() -> Column:
    """Key time, else written time, else a quarter beat for a grace note."""
    return F.coalesce("key_duration", F.when(F.col("duration") > 0, F.col("duration")).when(F.col("is_grace"), GRACE_SHOWN).otherwise(0.0))


def active_at(notes: DataFrame, points: DataFrame, keys: Sequence[str], at: str = "beat", width: float = 16.0) -> DataFrame:
    """J-19: the notes held at each point in time."""
    return stab_join(points, notes.withColumn("__len", shown_duration()), keys, at, F.col("start_beat") - 1e-9,
                     F.col("start_beat") + F.col("__len") - 1e-9, width).drop("__len")


def measure_at(measures: DataFrame, points: DataFrame, keys: Sequence[str], at: str = "beat", width: float = 16.0) -> DataFrame:
    """J-19: the first measure each point lies in, NULL outside all."""
    hit = stab_join(points, measures.select(*keys, "measure_index", "start_beat", "length"), keys, at, F.col("start_beat"),
                    F.col("start_beat") + F.col("length"), width)
    first = hit.groupBy(*points.columns).agg(F.min("measure_index").alias("measure_index"))
    return points.join(first, points.columns, "left")


def clip_to_window(events: DataFrame, from_beat: float, until_beat: float) -> DataFrame:
    """J-20: events that sound inside a window, cut to it."""
    end = F.col("start_beat") + F.col("duration")
    return (events.filter((F.col("start_beat") < until_beat - 1e-9) & (end > from_beat + 1e-9))
            .withColumn("clip_start", F.greatest("start_beat", F.lit(from_beat))).withColumn("clip_end", F.least(end, F.lit(until_beat))))


def name_spans(notes: DataFrame, keys: Sequence[str], min_beats: float = 0.0, chunk_width: float | None = None) -> DataFrame:
    """W-18: where each note's name ends: one name per struck key over its tied continuations; a second copy
    and the continuations get -1.

    Copies at one start are one row first (the first decides whether the tie goes on), then touching rows
    of a key chain up.
    """
    line, order = [*keys, "midi"], ["__start", "__id"]
    end = F.col("start_beat") + F.greatest(F.lit(min_beats), F.when(F.col("is_grace") | (F.col("duration") <= 0), 0.0).otherwise(F.col("duration")))
    n = notes.withColumn("__end", end).withColumn("__k", F.rint(F.col("start_beat") / STEP).cast("bigint"))
    first = F.struct("start_beat", "source_id")
    struck = n.groupBy(*line, "__k").agg(F.min_by(F.struct("source_id", "tie_stop", "start_beat"), first).alias("h"), F.max("__end").alias("__end"))
    struck = struck.select(*line, F.col("h.source_id").alias("source_id"), F.col("h.tie_stop").alias("__stop"),
                           F.col("h.start_beat").alias("__start"), F.col("h.source_id").alias("__id"), "__end")
    chunk = _chunk("__start", chunk_width)
    struck = previous(struck, line, order, {"__pend": "__end"}, chunk)
    goes_on = F.coalesce(F.col("__stop") & (F.abs(F.col("__pend") - F.col("__start")) < STEP), F.lit(False))
    struck = settle(islands(struck, line, order, ~goes_on, "__name", chunk), chunk)
    names = struck.groupBy(*line, "__name").agg(F.min_by("source_id", F.struct(*order)).alias("source_id"), F.max("__end").alias("__name_end"))
    return (notes.join(names.select(*keys, "source_id", "__name_end"), [*keys, "source_id"], "left")
            .withColumn("name_end", F.coalesce("__name_end", F.lit(-1.0))).drop("__name_end"))


def apply_corrections(notes: DataFrame, measures: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-24: a reader's corrections on every occurrence of a printed note, cut at the bar's end, keeping
    the share of the length the key is held.

    ``corrections``: printed_id, midi, hand, offset, duration. Invalid ones and those past the bar change nothing.
    """
    c = corrections.filter(F.col("midi").between(21, 108) & (F.coalesce("hand", F.lit("left")).isin("left", "right"))
                           & (F.col("offset") >= 0) & (F.col("duration") > 0) & (F.col("duration") <= 128))
    c = c.select(*keys, "printed_id", F.struct("midi", "hand", "offset", "duration").alias("__c"))
    m = measures.select(*keys, "measure_index", F.col("start_beat").alias("__ms"), F.col("length").alias("__ml"))
    n = notes.join(c, [*keys, "printed_id"], "left").join(m, [*keys, "measure_index"], "left")
    hit = F.coalesce(F.col("__c.offset") < F.col("__ml"), F.lit(False))
    span = F.least("__c.duration", F.col("__ml") - F.col("__c.offset"))
    share = F.when(F.col("duration") > 0, F.coalesce("key_duration", "duration") / F.col("duration")).otherwise(1.0)
    role = (F.when(F.col("__c.hand") == "right", 0).when(F.col("__c.hand") == "left", 1)
            .otherwise(F.greatest(F.lit(0), F.coalesce("staff", F.col("role") + 1) - 1)))
    changed = {"midi": F.when(hit, F.col("__c.midi")).otherwise(F.col("midi")), "hand": F.when(hit, F.col("__c.hand")).otherwise(F.col("hand")),
               "role": F.when(hit, role).otherwise(F.col("role")),
               "start_beat": F.when(hit, F.col("__ms") + F.col("__c.offset")).otherwise(F.col("start_beat")),
               "key_duration": F.when(hit, span * share).otherwise(F.col("key_duration")),
               "duration": F.when(hit, span).otherwise(F.col("duration")), "corrected": hit}
    return n.withColumns(changed).drop("__c", "__ms", "__ml")


def correct_audio(audio: DataFrame, corrected: DataFrame, original: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-24, sounding side: an event (``audio_id``, ``segment_ids``) takes its first segment's place, the pitch of
    any corrected segment, and ends with its last segment or the pedal release it had."""
    seg = audio.select(*keys, "audio_id", F.posexplode("segment_ids").alias("__i", "source_id"))
    new = corrected.select(*keys, "source_id", "midi", "role", F.col("start_beat").alias("__s"), "corrected",
                           (F.col("start_beat") + F.coalesce("key_duration", "duration")).alias("__ne"))
    old = original.select(*keys, "source_id", (F.col("start_beat") + F.coalesce("key_duration", "duration")).alias("__oe"))
    per = (seg.join(new, [*keys, "source_id"]).join(old, [*keys, "source_id"]).groupBy(*keys, "audio_id").agg(
        F.min_by(F.struct("midi", "role", "__s"), "__i").alias("__f"), F.min_by("midi", F.when(F.col("corrected"), F.col("__i"))).alias("__cm"),
        F.max("__ne").alias("__ne"), F.max("__oe").alias("__oe")))
    a = audio.join(per, [*keys, "audio_id"], "left")
    end = F.col("start_beat") + F.col("duration")
    release = F.when(end > F.col("__oe") + EPS, end).otherwise(0.0)
    found = F.col("__f").isNotNull()
    return a.withColumns({
        "duration": F.when(found, F.greatest("__ne", release) - F.col("__f.__s")).otherwise(F.col("duration")),
        "start_beat": F.when(found, F.col("__f.__s")).otherwise(F.col("start_beat")),
        "midi": F.coalesce("__cm", "__f.midi", "midi"), "role": F.coalesce("__f.role", "role")}).drop("__f", "__cm", "__ne", "__oe")


def resolve_labels(labels: DataFrame, edits: DataFrame, keys: Sequence[str], notation: str = "letters") -> DataFrame:
    """J-25: labels with a reader's edits: hidden ones go, the rest are moved, retyped and coloured."""
    e = edits.select(*keys, "label_id", F.struct("dx", "dy", "text", "hidden", "color").alias("__e"))
    l = labels.join(e, [*keys, "label_id"], "left").filter(~F.coalesce("__e.hidden", F.lit(False)))
    return l.withColumns({"x": F.col("x") + F.coalesce("__e.dx", F.lit(0.0)), "y": F.col("y") + F.coalesce("__e.dy", F.lit(0.0)),
                          "text": display_text(F.coalesce("__e.text", "text"), notation), "edited": F.col("__e").isNotNull(),
                          "color": F.col("__e.color")}).drop("__e")


# --- timing inside a bar ---------------------------------------------------------------------------

def _place(at: Column) -> Column:
    """Positions as whole ten-millionths, so that equal ones meet."""
    return F.rint(at * 1e7).cast("bigint")


def grace_timing(notes: DataFrame, keys: Sequence[str], chunk: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """W-20: grace notes take time from a neighbour; returns (notes, inserts).

    ``notes``: measure keys, part, voice, note_id, seq, start, duration, is_grace, chord, make_time,
    steal_previous, steal_following (percent or NULL). A run of graces before a main note splits one
    amount over its groups: the time it asks to be made, a share of the note before, or (by default 25 %,
    a quarter beat at most) of the note after. Made time is an insert that shifts the whole bar.
    """
    voice, order = [*keys, "part", "voice"], ["start", "seq"]
    # Only voices with graces are worked out, and only bars that time is put into are shifted; the other notes go through.
    graced, longer = F.coalesce("is_grace", F.lit(False)), F.col("is_grace") & (F.coalesce("make_time", F.lit(0.0)) > 0)
    if chunk is None:
        told = notes.withColumn("__graced", F.max(graced).over(Window.partitionBy(*voice))).withColumn("__longer", F.max(F.coalesce(longer, F.lit(False))).over(Window.partitionBy(*keys)))
    else:
        told = with_totals(with_totals(notes, voice, __graced=F.max(graced)), keys, __longer=F.max(F.coalesce(longer, F.lit(False))))
    n = previous(told.where("__graced"), voice, order, {"__pg": "is_grace"}, chunk)
    n = islands(n, voice, order, F.col("__pg").isNull() | (F.col("__pg") != F.col("is_grace")), "__run", chunk)
    n = settle(n, chunk)
    main = F.when(~F.col("is_grace"), F.struct("start", "duration"))
    n = carry_next(n, voice, order, main, "__next", chunk)
    n = settle(carry_last(n, voice, order, F.when(~F.col("is_grace") & ~F.col("chord"), F.struct("start", "duration", "note_id")), "__prev", chunk), chunk)
    n = previous(n, [*voice, "__run"], order, {"__first": "note_id"}, chunk)
    n = islands(n, [*voice, "__run"], order, ~F.col("chord") | F.col("__first").isNull(), "__group", chunk)
    n = settle(n.drop("__pg", "__first"), chunk)
    # A run's graces share the notes beside them, so a run is worked out on its own rows: those of one run, and the mains of one place, are few.
    run = Window.partitionBy(*voice, F.when(F.col("is_grace"), F.col("__run")), F.when(~F.col("is_grace"), _place(F.col("start"))))
    first = {c: F.min_by(c, F.struct(*order)).over(run).alias(f"__{c}") for c in ("make_time", "steal_previous", "steal_following")}
    n = n.select("*", F.max("__group").over(run).alias("__groups"), F.min("start").over(run).alias("__own"), *first.values(),
                 (F.row_number().over(run.orderBy(*order)) == 1).alias("__lead"))
    made = F.coalesce("__make_time", F.lit(0.0)) > 0
    has_next, has_prev = F.col("__next").isNotNull(), F.col("__prev").isNotNull()
    prev_end = F.col("__prev.start") + F.col("__prev.duration")
    takes_prev = ~made & has_prev & ((has_next & (F.coalesce("__steal_previous", F.lit(0.0)) > 0)) | ~has_next)
    takes_next = ~made & has_next & ~takes_prev
    from_next = F.when(F.col("__steal_following").isNull(), F.least(F.lit(GRACE_CAP), F.col("__next.duration") * GRACE_SHARE)).otherwise(
        F.least(F.col("__next.duration") * F.col("__steal_following") / 100, F.col("__next.duration")))
    n = n.withColumns({"__made": F.col("is_grace") & made, "__takes_prev": F.col("is_grace") & takes_prev, "__takes_next": F.col("is_grace") & takes_next, "__from_next": from_next})

    def taken(takes: str, at: str, amount: str) -> Column:
        """What runs take from the mains of a place, on these mains."""
        place = F.when(F.col(takes), F.col(at)).otherwise(F.col("start"))
        return F.sum(F.when(F.col(takes) & F.col("__lead"), F.col(amount))).over(Window.partitionBy(*voice, _place(place)))

    # What following notes give comes first: it shortens the note a later run may take from.
    n = n.withColumn("__late", taken("__takes_next", "__next.start", "__from_next"))
    n = carry_last(n, voice, order, F.when(~F.col("is_grace") & ~F.col("chord"), F.struct("__late")), "__given", chunk)
    left = F.col("__prev.duration") - F.coalesce("__given.__late", F.lit(0.0))
    from_prev = F.when(has_next, F.least(left, left * F.col("__steal_previous") / 100)).otherwise(F.least(F.lit(GRACE_CAP), left * GRACE_SHARE))
    n = n.withColumn("__amount", F.when(F.col("__made"), F.col("__make_time")).when(F.col("__takes_prev"), from_prev).when(F.col("__takes_next"), F.col("__from_next"))
                     .otherwise(F.lit(GRACE_CAP) * F.col("__groups")))
    # Mains that give time: those at the following onset, and those of the chord before.
    n = settle(n.withColumn("__cut", taken("__takes_prev", "__prev.start", "__amount")), chunk)
    amount = F.col("__amount")
    at = (F.when(F.col("__made") & has_next, F.col("__next.start")).when(F.col("__made"), F.coalesce(prev_end, F.lit(0.0)))
          .when(F.col("__takes_prev") & has_next, F.col("__next.start") - amount).when(F.col("__takes_prev"), prev_end - amount)
          .when(F.col("__takes_next"), F.col("__next.start")).otherwise(F.col("__own")))
    piece = amount / F.col("__groups")
    late, less = F.coalesce("__late", F.lit(0.0)), F.coalesce("__cut", F.lit(0.0))
    grace = F.col("is_grace")
    timed = cut_lineage(n.select(*[c for c in notes.columns if c not in ("start", "duration")], "__longer", "__made", amount.alias("__amount"),
                                 F.when(grace, at + (F.col("__group") - 1) * piece).otherwise(F.col("start") + late).alias("start"),
                                 F.when(grace, piece).otherwise(F.greatest(F.lit(0.0), F.col("duration") - late - less)).alias("duration"),
                                 F.when(F.col("__made"), at).alias("__made_at")))
    inserts = timed.filter("__made").select(*keys, F.col("__made_at").alias("at"), F.col("__amount").alias("amount")).distinct()
    columns = [*notes.columns, "__longer", "__made_at"]
    rest = told.where("NOT __graced").withColumn("duration", F.greatest(F.lit(0.0), "duration")).withColumn("__made_at", F.lit(None).cast("double"))
    every = timed.select(*columns).unionByName(rest.select(*columns))
    moved = insert_time(every.where("__longer").drop("__longer"), inserts, keys, ["note_id"], own="__made_at")
    return moved.unionByName(every.where("NOT __longer").drop("__longer")).drop("__made_at"), inserts


def insert_time(rows: DataFrame, inserts: DataFrame, keys: Sequence[str], ident: Sequence[str], start: str = "start", duration: str | None = "duration",
                closed_end: bool = False, own: str | None = None, chunk_width: float | None = None) -> DataFrame:
    """Rows after time was inserted into their bar: a monotone map of positions, linear between the inserts.

    ``inserts``: keys, at, amount; several at one place add up. A row that starts at or after an insert starts later; one that starts before it and
    ends after it (or, with ``closed_end``, at it) lasts longer; ``duration`` None moves points. ``own`` names the place of the insert that
    the row itself fills: that one doesn't move it. Places are compared within ``EPS``. ``ident`` names a row.

    Starts, ends and inserts are one ordered scan of each key: work grows with their number, and without ``chunk_width`` all steps need one exchange.
    """
    def point(kind: str, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.cast("double").alias("pos"))

    at_end = F.col(start) + F.col(duration) + (EPS if closed_end else -EPS) if duration else None
    wanted = [point("s", F.col(start) + EPS), *([point("e", at_end)] if duration else [])]
    if own:
        wanted += [point(kind, F.col(own) + add) for kind, add in (("i", EPS), ("x", -EPS))]
    payload = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    points = rows.select(*keys, payload.alias("__row"), F.explode(F.filter(F.array(*wanted), lambda p: p["pos"].isNotNull() | (p["kind"] == "s"))).alias("__p"))
    points = points.select(*keys, "__row", F.col("__p.kind").alias("__kind"), F.col("__p.pos").alias("__pos"), F.lit(0.0).alias("__amount"))
    given = inserts.select(*keys, F.lit(None).alias("__row"), F.lit("").alias("__kind"), F.col("at").cast("double").alias("__pos"), F.col("amount").cast("double").alias("__amount"))
    both = running_sum(points.unionByName(given), keys, ["__pos", "__kind"], F.col("__amount"), "__sum", _chunk("__pos", chunk_width))

    def of(kind: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("__kind") == kind, F.col("__sum"))), F.lit(0.0))

    told = both.where("__kind <> ''").select("*", *[F.col(f"__row.{c}").alias(f"__id_{c}") for c in ident])
    out = told.groupBy(*keys, *[f"__id_{c}" for c in ident]).agg(F.max_by("__row", F.when(F.col("__kind") == "s", 1)).alias("__row"), of("s").alias("__s"), of("e").alias("__e"),
                                                                 of("i").alias("__i"), of("x").alias("__x"))
    mine = F.when(F.col(f"__row.{own}") <= F.col(f"__row.{start}") + EPS, F.col("__i") - F.col("__x")).otherwise(0.0) if own else F.lit(0.0)
    changed = {start: F.col(f"__row.{start}") + F.col("__s") - mine}
    if duration:
        changed[duration] = F.col(f"__row.{duration}") + F.greatest(F.lit(0.0), F.col("__e") - F.col("__s"))
    return out.select(*[F.col(c) if c in keys else changed.get(c, F.col(f"__row.{c}")).alias(c) for c in rows.columns])


def lengthen_bars(bars: DataFrame, inserts: DataFrame, keys: Sequence[str], length: str = "length", graces_only: DataFrame | None = None) -> DataFrame:
    """Bars as long as before plus the time inserted; one of ``graces_only`` (keys) with inserts lasts as long as they do."""
    added = inserts.groupBy(*keys).agg(F.sum("amount").alias("__added"))
    out = bars.join(added, list(keys), "left")
    base = F.col(length)
    if graces_only is not None:
        out = out.join(graces_only.select(*keys, F.lit(True).alias("__bare")).distinct(), list(keys), "left")
        base = F.when(F.col("__bare") & F.col("__added").isNotNull(), 0.0).otherwise(base)
    return out.withColumn(length, base + F.coalesce("__added", F.lit(0.0))).select(*bars.columns)


def realize_bars(notes: DataFrame, events: DataFrame, bars: DataFrame, keys: Sequence[str], chunk: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """W-20 and W-21 together: (notes, events, bars) after graces have taken their time and fermatas are held.

    ``notes`` as for :func:`grace_timing`, with fermata; ``events``: keys, event_id, beat; ``bars``: keys, length. A bar of graces alone lasts as
    long as the time that they made.
    """
    timed, made = grace_timing(notes, keys, chunk)
    bare = notes.groupBy(*keys).agg(F.bool_and("is_grace").alias("g")).where("g")
    # Graces come after several scans and are read by all that follows.
    timed, made = cut_lineage(timed), cut_lineage(made)
    events = insert_time(events, made, keys, ["event_id"], "beat", None)
    bars = lengthen_bars(bars, made, keys, graces_only=bare)
    held = cut_lineage(fermata_holds(timed, keys))
    return (insert_time(timed, held, keys, ["note_id"], closed_end=True), insert_time(events, held, keys, ["event_id"], "beat", None), lengthen_bars(bars, held, keys))


def fermata_holds(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """W-21: (measure, at, amount) of every hold, in printed beats.

    A hold is half the longest held note, .5 to 2 beats. An earlier hold lengthens a note held across it, so
    the holds of a bar are folded in order; a bar has one entry per held start and end, few by notation.
    """
    held = notes.filter("fermata").groupBy(*keys, (F.col("start") + F.col("duration")).alias("at"), "start").agg(
        F.max("duration").alias("duration"))
    per = held.groupBy(*keys, "at").agg(F.collect_list(F.struct("start", "duration")).alias("held"))
    bars = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "held"))).alias("__p"))
    kind = "array<struct<at: double, amount: double>>"

    def step(acc: Column, p: Column) -> Column:
        longest = F.array_max(F.transform(p["held"], lambda h: h["duration"] + F.aggregate(
            F.filter(acc, lambda a: a["at"] > h["start"] + EPS), F.lit(0.0), lambda s, a: s + a["amount"])))
        amount = F.greatest(F.lit(FERMATA_LEAST), F.least(F.lit(FERMATA_MOST), longest * FERMATA_SHARE))
        return F.concat(acc, F.array(F.struct(p["at"].alias("at"), amount.alias("amount")))).cast(kind)

    return bars.select(*keys, F.explode(F.aggregate("__p", F.array().cast(kind), step)).alias("__h")).select(*keys, "__h.*")


def fermata_hold(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """W-21: notes after a hold start later, notes ending at it or sounding across it last longer."""
    return insert_time(notes, fermata_holds(notes, keys), keys, ["note_id"], closed_end=True)


def state_at_jumps(order: DataFrame, events: DataFrame, staves: DataFrame, keys: Sequence[str],
                   tempo_bpm: float = DEFAULT_TEMPO, chunk_rows: int | None = None) -> DataFrame:
    """W-22: expression events of a performance: each played bar's own, and at every jump the defaults
    and then the last mark printed before the bar jumped to.

    ``order``: position, measure_index, start_beat. ``events``: measure_index, beat, seq, kind, part, staff, value.
    ``staves``: the (part, staff) pairs of a document. Adds ``rank``: 0 defaults, 1 restored, 2 the pedal's
    lift, so that a restored pedal is not held through the jump, 3 printed. A first bar of index 0 is no jump.
    """
    played = previous(order, keys, ["position"], {"__pi": "measure_index"}, _chunk("position", chunk_rows))
    jumps = played.filter(F.col("measure_index") != F.coalesce("__pi", F.lit(-1)) + 1).select(
        *keys, "position", "measure_index", "start_beat")
    cols = [*keys, "position", "start_beat", "kind", "part", "staff", "value", "rank"]

    def default(df, kind, value, part, staff, rank=0):
        return df.withColumns({"kind": F.lit(kind), "value": F.lit(value).cast("string"), "part": part, "staff": staff, "rank": F.lit(rank)}).select(*cols)

    pairs = staves.select(*keys, "part", "staff").distinct()
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    opened = default(jumps, "tempo", float(tempo_bpm), zero, one)
    loud = default(jumps.join(pairs, list(keys)), "dynamic", DEFAULT_DYNAMIC, F.col("part"), F.col("staff"))
    lifted = default(jumps.join(pairs.select(*keys, "part").distinct(), list(keys)), "pedal", "stop", F.col("part"), one, 2)
    carried = events.filter(F.col("kind").isin("tempo", "dynamic", "pedal"))
    lines = carried.select(*keys, "kind", "part", "staff").distinct()
    asked = jumps.join(lines, list(keys)).withColumn("__at", F.col("measure_index").cast("double") - 0.5)
    rank = F.struct("beat", "seq")
    last = carried.groupBy(*keys, "kind", "part", "staff", "measure_index").agg(F.max_by("value", rank).alias("value"))
    marks = last.select(*keys, "kind", "part", "staff", F.col("measure_index").cast("double").alias("__at"), F.col("value").cast("string").alias("value"))
    restored = asof_join(asked, marks, [*keys, "kind", "part", "staff"], "__at", ["value"], chunk_width=chunk_rows)
    restored = restored.filter(F.col("value").isNotNull()).withColumn("rank", F.lit(1)).select(*cols)
    own = (order.select(*keys, "position", "measure_index", "start_beat").join(events, [*keys, "measure_index"])
           .withColumn("start_beat", F.col("start_beat") + F.col("beat")).withColumn("value", F.col("value").cast("string"))
           .withColumn("rank", F.lit(3)).select(*cols))
    out = opened
    for more in (loud, lifted, restored, own):
        out = out.unionByName(more)
    return out
