"""From detections and relation edges to resolved pitches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.pitch import midi_of_diatonic
from quaverlake.operators.asof import asof_join
from quaverlake.operators.segments import carry_last, row_index
from quaverlake.session import cut_lineage


def effective_clef_key(heads: DataFrame, clefs: DataFrame, pdf_clefs: DataFrame, keysigs: DataFrame, staves: DataFrame,
                       doc: Sequence[str], chunk_width: float | None = None) -> DataFrame:
    """J-10: clef and key in force at each head: the printed clef, else the recognised one, else the last of
    the same role's staff before, else treble for the first role and bass for the others; keys likewise, then 0.

    ``heads``: page, staff, x. Events: page, staff, x, seq, value. ``staves``: page, staff, role, staff_order.
    """
    staff = [*doc, "page", "staff"]

    def last_of(events: DataFrame, out: str) -> DataFrame:
        return events.groupBy(*staff).agg(F.max_by("value", F.struct("x", "seq")).alias(out))

    s = staves.join(last_of(clefs, "__lc"), staff, "left").join(last_of(keysigs, "__lk"), staff, "left")
    order, line = ["page", "staff_order"], [*doc, "role"]
    s = carry_last(s, line, order, F.col("__lc"), "__ic", inclusive=False)
    s = carry_last(s, line, order, F.col("__lk"), "__ik", inclusive=False)
    home = s.select(*staff, "role", F.coalesce("__ic", F.when(F.col("role") == 0, "G").otherwise("F")).alias("__dc"),
                    F.coalesce("__ik", F.lit(0)).alias("__dk"))
    out = heads
    for events, name in ((clefs, "__omr"), (pdf_clefs, "__pdf"), (keysigs, "__key")):
        out = asof_join(out, events.select(*staff, "x", F.col("seq").alias("__seq"), F.col("value").alias(name)), staff, "x", [name],
                        seq="__seq", chunk_width=chunk_width)
    out = out.join(home, staff, "left")
    omr = F.coalesce("__omr", "__dc")
    return out.withColumns({"recognized_clef": omr, "clef": F.coalesce(F.col("__pdf"), omr),
                            "clef_source": F.when(F.col("__pdf").isNotNull(), "pdf").otherwise("omr"),
                            "key_fifths": F.coalesce("__key", "__dk")}).drop("__omr", "__pdf", "__key", "__dc", "__dk")


# --- edges -----------------------------------------------------------------------------------------

def tie_pairs(edges: DataFrame, slurs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-21: earlier and later head of each tie slur, from its LEFT and RIGHT edges."""
    ties = slurs.filter("tie").select(*keys, F.col("slur_id").alias("source"))
    e = edges.filter(F.col("kind") == "slur-head").join(ties, [*keys, "source"], "left_semi")

    def side(s: str) -> Column:
        return F.max_by("target", F.when(F.col("side") == s, F.col("seq"))).alias(s.lower())
    return e.groupBy(*keys, "source").agg(side("LEFT"), side("RIGHT"))


def tie_stop_heads(edges: DataFrame, slurs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-21: heads a tie leads to."""
    return tie_pairs(edges, slurs, keys).filter(F.col("right").isNotNull()).select(*keys, F.col("right").alias("head_id")).distinct()


def alter_map(edges: DataFrame, alters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-21: the accidental shape attached to each head, the last written where there are several."""
    e = edges.filter(F.col("kind") == "alter-head").join(alters.select(*keys, F.col("alter_id").alias("source"), "shape"), [*keys, "source"])
    return e.groupBy(*keys, F.col("target").alias("head_id")).agg(F.max_by("shape", "seq").alias("shape"))


def chord_map(edges: DataFrame, chords: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-21: the chord that owns each head."""
    ids = chords.select(*keys, F.col("chord_id").alias("source"))
    e = edges.filter(F.col("kind") == "containment").join(ids, [*keys, "source"], "left_semi")
    return e.groupBy(*keys, F.col("target").alias("head_id")).agg(F.max_by("source", "seq").alias("chord_id"))


def tie_roots(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first head of the chain each tied head ends: pointer doubling, as many rounds as the logarithm
    of the longest chain. ``pairs``: left, right."""
    links = cut_lineage(pairs.filter(F.col("left").isNotNull() & F.col("right").isNotNull())
                        .groupBy(*keys, F.col("right").alias("head_id")).agg(F.max("left").alias("root")))
    while True:
        up = links.select(*keys, F.col("head_id").alias("root"), F.col("root").alias("__up"))
        step = cut_lineage(links.join(up, [*keys, "root"], "left"))
        if step.filter(F.col("__up").isNotNull() & (F.col("__up") != F.col("head_id"))).isEmpty():
            return links
        links = step.select(*keys, "head_id", F.coalesce("__up", "root").alias("root"))


def chord_onsets(stacks: DataFrame, slots: DataFrame, measures: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-38: system, slot, voice and onset of every chord; chords never placed keep a NULL onset.

    ``stacks``: system, stack_seq, stack_id, special. ``slots``: stack_seq, slot_id, offset ("3/4", in whole
    notes). ``measures``: system, part, measure_seq, measure_id, chord_ids. ``entries``: system, part, measure_seq,
    chord_id, voice, slot_id, status. Courtesy stacks are left out; the second half of a split bar is
    named with an X; the n-th stack of a label meets the n-th measure of that label in each part.
    """
    line = [*keys, "system"]
    label = F.concat(F.when(F.col("special") == "SECOND_HALF", "X").otherwise(""), F.col("stack_id"))
    s = stacks.filter(~F.coalesce(F.col("special") == "CAUTIONARY", F.lit(False))).withColumn("measure_id", label)
    s = row_index(s, line, ["stack_seq"], "__slot")
    s = row_index(s, [*line, "measure_id"], ["stack_seq"], "__nth")
    m = row_index(measures, [*line, "part", "measure_id"], ["measure_seq"], "__nth")
    placed = m.join(s.select(*line, "stack_seq", "measure_id", "__nth", (F.col("__slot") - 1).alias("slot")), [*line, "measure_id", "__nth"])
    chords = placed.select(*line, "part", "measure_seq", "measure_id", "stack_seq", "slot", F.explode("chord_ids").alias("chord_id"))
    parts = F.split("offset", "/")
    beats = parts[0].cast("double") / F.coalesce(F.try_element_at(parts, F.lit(2)).cast("double"), F.lit(1.0)) * 4
    times = slots.select(*keys, "stack_seq", "slot_id", beats.alias("onset"))
    begun = entries.filter(F.col("status") == "BEGIN").select(*line, "part", "measure_seq", "chord_id", "voice", "slot_id")
    return (chords.join(begun, [*line, "part", "measure_seq", "chord_id"], "left").join(times, [*keys, "stack_seq", "slot_id"], "left")
            .select(*line, "part", "measure_id", "slot", "chord_id", "voice", "onset"))


# --- accidentals in a bar --------------------------------------------------------------------------

def carry_marks(heads: DataFrame, bar: Sequence[str], time: str = "onset", ties: DataFrame | None = None,
                chunk_width: float | None = None) -> DataFrame:
    """W-03: the alteration of each head from the marks before it in its bar.

    ``heads``: bar keys (document, page, staff, bar, key position), head_id, ``time``, diatonic, explicit (NULL
    without a mark), key_alter. Heads at one time are one batch. A batch whose marks for a staff position
    agree sets it, for itself and for later heads; one whose marks conflict clears it and leaves the batch
    and later heads of that position uncertain until a mark agrees again. Tied heads (``ties``: head_id,
    root) sound like the head their chain started with.
    """
    line = [*bar, "diatonic"]
    batches = heads.groupBy(*line, time).agg(F.min("explicit").alias("__lo"), F.max("explicit").alias("__hi"))
    agreed = F.col("__lo") == F.col("__hi")
    mark = F.when(F.col("__lo").isNotNull(), F.struct(agreed.alias("ok"), F.col("__lo").alias("v")))
    batches = batches.withColumn("__mark", mark)
    chunk = F.floor(F.col(time) / F.lit(chunk_width)).cast("bigint") if chunk_width else None
    batches = carry_last(batches, line, [time], F.col("__mark"), "__before", chunk, inclusive=False).drop("__lo", "__hi")
    clash = batches.groupBy(*bar, time).agg(F.bool_or(F.coalesce(~F.col("__mark.ok"), F.lit(False))).alias("__clash"))
    h = heads.join(batches, [*line, time]).join(clash, [*bar, time])
    set_now, set_before = F.coalesce("__mark.ok", F.lit(False)), F.coalesce("__before.ok", F.lit(False))
    alter = F.coalesce("explicit", F.when(set_now, F.col("__mark.v")), F.when(set_before, F.col("__before.v")), "key_alter")
    doubt = F.when(set_now, False).when(F.col("__clash"), True).otherwise(F.col("__before").isNotNull() & ~set_before)
    h = h.withColumn("alter", alter).withColumn("pitch_uncertain", doubt).drop("__mark", "__before", "__clash")
    if ties is not None:
        keys = [c for c in ties.columns if c not in ("head_id", "root")]
        source = h.select(*keys, F.col("head_id").alias("root"), F.col("diatonic").alias("__d"), F.col("alter").alias("__a"))
        chain = ties.join(source, [*keys, "root"]).drop("root")
        h = (h.join(chain, [*keys, "head_id"], "left").withColumn("diatonic", F.coalesce("__d", "diatonic"))
             .withColumn("alter", F.coalesce("__a", "alter")).drop("__d", "__a"))
    return h.withColumn("midi", midi_of_diatonic(F.col("diatonic"), F.col("alter")))
