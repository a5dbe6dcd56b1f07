"""From an ordered element table to measures and notes of the written score.

``keys`` names the part (and document); positions are in beats, quarter notes. ``chunk`` expressions
cut long parts; see :mod:`quaverlake.operators.segments`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.operators.asof import asof_join
from quaverlake.operators.bands import stab_join
from quaverlake.operators.segments import carry_last, carry_next, following, islands, previous, row_index, running_min, running_sum, settle

TOLERANCE = 1e-7
PICKUP = "Inferred pickup length."
DIFFERS = "Recognized duration differs from the time signature; playback timing is inferred."
BACKUP = "Voice backup extends before the measure."


def cursor(elements: DataFrame, keys: Sequence[str], measure: str = "measure_seq", seq: str = "seq",
           chunk: Column | None = None, bar_chunk: Column | None = None) -> DataFrame:
    """W-06: start and length in beats of every note of an element table.

    ``elements``: kind (note, backup, forward, attributes, ...), duration, divisions, chord, grace.
    The cursor is a running sum that may not fall below zero. Clamping makes it non-linear, but
    equals the sum minus its lowest value below zero so far, which two plain scans give. ``chunk`` cuts a
    part by its measures for the divisions in force; the rest runs bar by bar, which ``bar_chunk`` can cut further.
    """
    order = [measure, seq]
    divided = carry_last(elements, keys, order, F.when(F.col("divisions") > 0, F.col("divisions")), "__div", chunk)
    length = F.coalesce(F.col("duration"), F.lit(0)) / F.coalesce(F.col("__div"), F.lit(1))
    note = F.col("kind") == "note"
    leads = note & ~F.coalesce("chord", F.lit(False))
    step = (F.when(leads & ~F.coalesce("grace", F.lit(False)), length).when(F.col("kind") == "forward", length)
            .when(F.col("kind") == "backup", -length).otherwise(0.0))
    rows = settle(divided.withColumn("length", length).withColumn("__step", step), chunk)
    bar = [*keys, measure]
    rows = running_sum(rows, bar, [seq], F.col("__step"), "__sum", bar_chunk)
    rows = running_min(rows, bar, [seq], F.col("__sum"), "__low", bar_chunk)
    rows = settle(rows, bar_chunk)
    after = F.col("__sum") - F.least(F.lit(0.0), F.col("__low"))
    rows = previous(rows.withColumn("__after", after), bar, [seq], {"__plow": "__low", "__pafter": "__after"}, bar_chunk)
    clamped = (F.col("kind") == "backup") & (F.coalesce("__pafter", F.lit(0.0)) + F.col("__step") < -TOLERANCE)
    rows = rows.withColumn("clamped", clamped).withColumn("__at", F.coalesce("__pafter", F.lit(0.0)))
    rows = carry_last(rows, bar, [seq], F.when(leads, F.col("__at")), "start", bar_chunk)
    return rows.drop("__div", "__step", "__sum", "__low", "__after", "__plow", "__pafter", "__at")


def content_lengths(timed: DataFrame, keys: Sequence[str], measure: str = "measure_seq") -> DataFrame:
    """W-06: the furthest note end of each measure, and whether a backup ran over its start."""
    sounding = (F.col("kind") == "note") & ~F.coalesce("grace", F.lit(False))
    return timed.groupBy(*keys, measure).agg(
        F.coalesce(F.max(F.when(sounding, F.col("start") + F.col("length"))), F.lit(0.0)).alias("content"),
        F.when(F.bool_or("clamped"), F.array(F.lit(BACKUP))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def layout_counters(measures: DataFrame, keys: Sequence[str], index: str = "measure_seq",
                    chunk: Column | None = None) -> DataFrame:
    """W-07: page, system, slot in the system and occurrence of every measure of a part.

    ``measures``: label, new_page, new_system, page_number (NULL when not given), rest_bars (a
    multimeasure rest's count, 0 otherwise). The bars of such a rest share its slot while the system lasts.
    """
    order = [index]
    first = F.col(index) == F.col("__first")
    m = measures.join(measures.groupBy(*keys).agg(F.min(index).alias("__first")), list(keys))
    number = F.when((F.col("new_page") | first) & F.col("page_number").isNotNull(), F.col("page_number"))
    turn = F.when(F.col("new_page") & F.col("page_number").isNull(), 1).otherwise(0).cast("bigint")
    line = F.when(F.col("new_system") & ~F.col("new_page"), 1).otherwise(0).cast("bigint")
    m = running_sum(m, keys, order, turn, "__turns", chunk)
    m = settle(running_sum(m, keys, order, line, "__lines", chunk), chunk)
    base = F.when(number.isNotNull(), F.struct(number.alias("p"), F.col("__turns").alias("t")))
    m = carry_last(m, keys, order, base, "__page", chunk)
    m = settle(carry_last(m, keys, order, F.when(F.col("new_page"), F.col("__lines")), "__line0", chunk), chunk)
    page = F.coalesce(F.col("__page.p") + F.col("__turns") - F.col("__page.t"), F.col("__turns") + 1)
    m = m.withColumn("page", page.cast("bigint")).withColumn(
        "system", (F.col("__lines") - F.coalesce("__line0", F.lit(0))).cast("bigint"))
    # A line of music is the run since the last new page or system.
    m = islands(m, keys, order, F.col("new_page") | F.col("new_system") | first, "__line", chunk)
    line_keys = [*keys, "__line"]
    rest = F.when(F.col("rest_bars") >= 1, F.struct(F.col(index).alias("i"), F.col("rest_bars").alias("n")))
    m = settle(carry_last(m, line_keys, order, rest, "__rest", chunk, inclusive=False), chunk)
    inside = F.coalesce(F.col(index) - F.col("__rest.i") < F.col("__rest.n"), F.lit(False))
    m = m.withColumn("rest_continuation", inside)
    m = running_sum(m, line_keys, order, F.when(inside, 0).otherwise(1).cast("bigint"), "__slots", chunk)
    m = m.withColumn("slot", F.col("__slots") - 1)
    m = row_index(m, [*keys, "label"], order, "__occ", chunk)
    return m.withColumn("occurrence", F.col("__occ") - 1).drop(
        "__first", "__turns", "__lines", "__page", "__line0", "__line", "__rest", "__slots", "__occ")


def merge_parts(measures: DataFrame, keys: Sequence[str], part: str = "part") -> DataFrame:
    """A-37: the same measure (label, occurrence) of several parts as one row.

    Lengths are maxima, flags are ORed, ending numbers united; page, system and slot come from the
    longest part that has the measure. Events are compared as (kind, beat, value) rows.
    """
    sizes = measures.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__len"))
    m = measures.join(sizes, [*keys, part])
    ident = [*keys, "label", "occurrence"]
    layout = F.struct("page", "system", "slot")
    out = m.groupBy(*ident).agg(
        F.max("nominal").alias("nominal"), F.max("content").alias("content"),
        F.max("repeat_backward").alias("repeat_backward"), F.bool_or("repeat_forward").alias("repeat_forward"),
        F.max_by(F.struct("page", "system", "slot", "implicit", "measure_index"), F.struct("__len", -F.col(part))).alias("__l"))
    # Endings and events are made distinct before they are listed, so many parts that agree add nothing.
    ends = (m.select(*ident, F.explode("endings").alias("__e")).distinct().groupBy(*ident)
            .agg(F.array_sort(F.collect_list("__e")).alias("endings")))
    events = (m.select(*ident, F.explode("events").alias("__v")).distinct().groupBy(*ident)
              .agg(F.array_sort(F.collect_list("__v")).alias("events")))
    joined = out.select(*ident, "__l.*", "nominal", "content", "repeat_backward", "repeat_forward")
    for extra in (ends, events):
        joined = joined.join(extra, ident, "left")
    return joined.withColumns({"endings": F.coalesce("endings", F.array().cast(measures.schema["endings"].dataType)),
                               "events": F.coalesce("events", F.array().cast(measures.schema["events"].dataType))})


def measure_lengths(measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-38: played length and warnings from nominal and written length; a short first bar is a pickup."""
    firsts = measures.groupBy(*keys).agg(F.min("measure_index").alias("__first"))
    m = measures.join(firsts, list(keys))
    nominal, content = F.col("nominal"), F.col("content")
    irregular = F.coalesce("implicit", F.lit(False)) | (nominal == 0) | F.startswith(F.col("label"), F.lit("X"))
    pickup = (F.col("measure_index") == F.col("__first")) & (content > 0) & (content < nominal)
    warn = F.when((nominal != 0) & (F.abs(content - nominal) > TOLERANCE) & ~irregular,
                  F.when(pickup, PICKUP).otherwise(DIFFERS))
    return (m.withColumn("length", F.when(irregular | pickup, content).otherwise(F.greatest(nominal, content)))
            .withColumn("warnings", F.array_compact(F.array(warn))).drop("__first"))


def carry_endings(measures: DataFrame, keys: Sequence[str], index: str = "measure_index",
                  chunk: Column | None = None) -> DataFrame:
    """W-26: the ending numbers in force at each measure between a bracket's start and stop.

    ``measures``: ending_start, ending_stop (number arrays, NULL without one). A stop outside a
    bracket stands for itself.
    """
    empty = F.array().cast(measures.schema["ending_start"].dataType)
    state = F.when(F.col("ending_stop").isNotNull(), empty).when(F.col("ending_start").isNotNull(), F.col("ending_start"))
    m = carry_last(measures, keys, [index], state, "__open", chunk, inclusive=False)
    running = F.when(F.size("__open") > 0, F.col("__open"))
    return (m.withColumn("endings", F.coalesce(F.nullif("ending_start", empty), running, F.col("ending_stop"), empty))
            .drop("__open"))


def repeat_pairs(measures: DataFrame, keys: Sequence[str], index: str = "measure_index", chunk_width: int | None = None) -> DataFrame:
    """(keys, first, last, times) for each repeat: brackets matched by running depth, the rest going back to their section.

    ``measures``: repeat_forward, repeat_backward (times, 0 without), endings; optionally section_start, section_end, signature. A backward sign
    goes with the last forward sign that is still open. One without goes back to the start of its section: after the last repeat and the
    endings that close it, after a double bar line that no new key or time follows, or to a bar that opens a section without one.
    A repeat that would begin after its own bar is left out.
    """
    chunk = None if chunk_width is None else F.floor(F.col(index) / chunk_width).cast("bigint")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in measures.columns else F.lit(False).alias(c) for c in ("section_start", "section_end", "signature")]
    m = measures.select(*keys, F.col(index).cast("bigint").alias("__i"), F.coalesce("repeat_forward", F.lit(False)).alias("fwd"), F.coalesce("repeat_backward", F.lit(0)).alias("times"),
                        (F.coalesce(F.size("endings"), F.lit(0)) > 0).alias("__has"), *flags)
    mine = None if chunk_width is None else F.floor(F.col("__i") / chunk_width).cast("bigint")
    m = following(m, keys, ["__i"], {"__sig": "signature"}, mine)
    m = settle(carry_next(m, keys, ["__i"], F.when(~F.col("__has"), F.col("__i")), "__plain", mine, inclusive=True), chunk)
    # Depth: forward signs open, backward signs close; a sign that closes nothing leaves it at 0.
    step = F.array(F.when(F.col("fwd"), F.struct(F.lit(0).alias("phase"), F.lit(1).alias("by"))), F.when(F.col("times") > 0, F.struct(F.lit(1).alias("phase"), F.lit(-1).alias("by"))))
    signs = m.select(*keys, "__i", "times", F.explode(F.array_compact(step)).alias("s")).select(*keys, "__i", "times", "s.*")
    signs = running_sum(signs, keys, ["__i", "phase"], F.col("by").cast("bigint"), "__sum", mine)
    signs = running_min(settle(signs, chunk), keys, ["__i", "phase"], F.col("__sum"), "__low", mine)
    # Before the sign the sum was __sum - by; what stood below 0 by then is not owed.
    signs = previous(signs, keys, ["__i", "phase"], {"__plow": "__low"}, mine)
    depth = F.col("__sum") - F.col("by") - F.least(F.lit(0), F.coalesce("__plow", F.lit(0)))
    signs = settle(signs.select(*keys, "__i", "phase", "times", (depth + F.when(F.col("by") > 0, 1).otherwise(0)).alias("__level")), chunk)
    opened = signs.where("phase = 0").select(*keys, "__level", F.col("__i").alias("__at"), F.col("__i").alias("__first"))
    closed = signs.where("phase = 1").select(*keys, "__i", "times", "__level", F.col("__i").alias("__at"))
    matched = asof_join(closed.where("__level > 0"), opened, [*keys, "__level"], "__at", ["__first"], chunk_width=chunk_width)
    # Marks that begin a section, at the half bar where they start to hold.
    ends = (F.col("times") > 0) | (F.col("section_end") & ~F.coalesce("__sig", F.lit(False)))
    marks = m.select(*keys, F.explode(F.array_compact(F.array(
        F.when(F.col("section_start") & ~F.col("signature"), F.struct((F.col("__i") * 2).alias("__at"), F.col("__i").alias("__base"))),
        F.when(ends, F.struct((F.col("__i") * 2 + 1).alias("__at"), (F.col("__i") + 1).alias("__base")))))).alias("k")).select(*keys, "k.*")
    bases = marks.join(m.select(*keys, F.col("__i").alias("__base"), F.col("__plain"), F.col("__has")), [*keys, "__base"], "left")
    at_zero = m.groupBy(*keys).agg(F.min_by("__plain", "__i").alias("__plain"), F.min_by("__has", "__i").alias("__has")).select(*keys, F.lit(-1).cast("bigint").alias("__at"),
                                                                                                                     F.lit(0).cast("bigint").alias("__base"), "__plain", "__has")
    bases = bases.select(*keys, "__at", "__base", "__plain", "__has").unionByName(at_zero)
    # Bars with endings at the start of a section belong to the repeat before; with no bar after them the section is empty.
    bases = bases.select(*keys, "__at", F.when(F.coalesce("__has", F.lit(False)), F.coalesce("__plain", F.lit(1 << 60))).otherwise(F.col("__base")).alias("__first"))
    loose = closed.where("__level = 0").withColumn("__at", F.col("__i") * 2)
    unmatched = asof_join(loose, bases, keys, "__at", ["__first"], chunk_width=None if chunk_width is None else 2 * chunk_width)
    cols = [*keys, F.col("__first").alias("first"), F.col("__i").alias("last"), F.col("times").cast("int").alias("times")]
    return matched.select(*cols).unionByName(unmatched.select(*cols)).where("first <= last")


def expand_repeats(measures: DataFrame, keys: Sequence[str], index: str = "measure_index",
                   chunk: Column | None = None, chunk_width: int | None = None) -> DataFrame:
    """W-25: measures in their repeats: every repeat is played as often as its sign says, nested ones anew in each pass of the outer one.

    ``measures`` as for :func:`repeat_pairs`. A bar with ending numbers is played in the passes of its innermost repeat that it names; right
    after a repeat if it names its last pass; elsewhere as printed, marked ``orphan_ending``.
    Adds ``pass`` and ``path``: start and pass of each repeat around the bar, from the outermost, then its index. Paths in order are the
    performance. Jumps (da capo, dal segno, coda) are not followed.
    """
    width = chunk_width or 64
    pairs = repeat_pairs(measures, keys, index, chunk_width if chunk is None else width)
    pairs = settle(pairs, F.lit(0))
    at = measures.select(*keys, F.col(index).cast("bigint").alias("__i"))
    around = stab_join(at, pairs.select(*keys, "first", "last", "times"), keys, "__i", F.col("first"), F.col("last"), float(width), closed_right=True)
    # The repeats around one bar: as many as they are nested.
    nest = around.groupBy(*keys, "__i").agg(F.array_sort(F.collect_list(F.struct("first", (-F.col("last")).alias("__l"), "times"))).alias("__nest"))
    has = F.coalesce(F.size("endings"), F.lit(0)) > 0
    m = measures.withColumn("__i", F.col(index).cast("bigint")).join(nest, [*keys, "__i"], "left")
    # What counts as the last pass: that of the repeat which ended last; a bar without endings outside all repeats starts anew.
    inner = F.element_at("__nest", -1)
    told = F.when(inner["__l"] == -F.col("__i"), inner["times"]).when(F.col("__nest").isNull() & (~has | (F.coalesce("repeat_backward", F.lit(0)) > 0)), 1)
    mine = None if chunk is None else F.floor(F.col("__i") / width).cast("bigint")
    m = carry_last(settle(m, chunk), keys, ["__i"], told, "__last_pass", mine, inclusive=False).withColumn("__last_pass", F.coalesce("__last_pass", F.lit(1)))
    grown = F.aggregate(F.coalesce("__nest", F.array().cast("array<struct<first:bigint,__l:bigint,times:int>>")), F.array(F.array().cast("array<bigint>")),
                        lambda acc, p: F.flatten(F.transform(acc, lambda path: F.transform(F.sequence(F.lit(1), p["times"]), lambda k: F.concat(path, F.array(p["first"], k.cast("bigint")))))))
    out = m.withColumn("path", F.explode(grown))
    bare = F.size("path") == 0
    out = out.withColumn("pass", F.when(bare, F.col("__last_pass")).otherwise(F.element_at("path", -1)).cast("int"))
    out = out.withColumn("orphan_ending", has & bare & (F.col("__last_pass") == 1))
    played = out.where(~has | F.col("orphan_ending") | F.coalesce(F.array_contains("endings", F.col("pass")), F.lit(False)))
    return played.withColumn("path", F.concat("path", F.array("__i"))).drop("__i", "__nest", "__last_pass")


def performance_position(expanded: DataFrame, keys: Sequence[str], index: str = "measure_index",
                         chunk: Column | None = None) -> DataFrame:
    """The 0-based place of each played measure, by its path; a ``chunk`` is one of the path's first entry, its outermost repeat."""
    out = row_index(expanded, keys, ["path"], "__p", chunk)
    return out.withColumn("position", F.col("__p") - 1).drop("__p")


def expand_rests(measures: DataFrame, starts: DataFrame, keys: Sequence[str], most_bars: int, index: str = "measure_index") -> DataFrame:
    """W-19: a multimeasure rest glued to the bar before it gets its own bars, and bars are renumbered.

    ``measures``: page, system, label, implicit, nominal, content, length, repeat_backward, glued_bars
    and glued_at (NULL without). ``starts``: page, system, number printed at a system's start. The count
    comes from the next system's printed number if that tells of ``most_bars`` at most, else from the export when it says two bars or more.
    """
    system = [*keys, "page", "system"]
    s = measures.groupBy(*system).agg(F.count(F.lit(1)).alias("__n"), F.bool_or("implicit").alias("__imp"), F.min(index).alias("__i"))
    s = s.join(starts.select(*system, F.col("number").alias("__start")), system, "left")
    # The next system of the document: one row per system here, so the window is short.
    from pyspark.sql import Window as W
    s = s.withColumn("__next", F.lead("__start").over(W.partitionBy(*keys).orderBy("__i")))
    told = F.when(~F.col("__imp"), F.col("__next") - F.col("__start") - F.col("__n"))
    s = s.withColumn("__told", F.when(told.between(1, most_bars), told))
    m = measures.join(s.select(*system, "__start", "__told"), system)
    bars = F.coalesce(F.col("__told"), F.when(F.col("glued_bars") >= 2, F.col("glued_bars")))
    m = m.withColumn("__bars", F.when(F.col("glued_bars").isNotNull() & ~F.col("implicit"), bars))
    split = F.col("__bars").isNotNull()
    own = m.withColumns({
        "content": F.when(split, F.col("glued_at")).otherwise(F.col("content")),
        "length": F.when(split, F.greatest("nominal", "glued_at")).otherwise(F.col("length")),
        "__rb": F.col("repeat_backward"), "sub": F.lit(0), "rest_of": F.lit(0).cast("bigint")})
    own = own.withColumn("repeat_backward", F.when(split, F.lit(0)).otherwise(F.col("repeat_backward")))
    rests = own.filter(split).withColumn("sub", F.explode(F.sequence(F.lit(1), F.col("__bars").cast("int"))))
    rests = rests.withColumns({"content": F.lit(0.0), "length": F.col("nominal"), "rest_of": F.col("__bars").cast("bigint"),
                               "repeat_backward": F.when(F.col("sub") == F.col("__bars"), F.col("__rb")).otherwise(F.lit(0))})
    rows = own.unionByName(rests)
    # Renumber the systems of documents with a split from their printed start.
    fixed = rows.groupBy(*keys).agg(F.bool_or(split).alias("__any"))
    digits = rows.groupBy(*system).agg(F.min(F.col("label").rlike(r"^\d+$").cast("int")).alias("__digits"))
    rows = rows.join(fixed, list(keys)).join(digits, system)
    rows = row_index(rows, system, [index, "sub"], "__k")
    number = (F.col("__start") + F.col("__k") - 1).cast("string")
    ok = F.col("__any") & (F.col("__digits") == 1) & F.col("__start").isNotNull()
    return rows.withColumn("label", F.when(ok, number).otherwise(F.col("label"))).drop(
        "__start", "__told", "__bars", "__rb", "__any", "__digits", "__k", "glued_bars", "glued_at")


def carry_meter(measures: DataFrame, keys: Sequence[str], index: str = "measure_index",
                chunk: Column | None = None) -> DataFrame:
    """W-24: printed meters carry forward and correct the nominal length; doubt carries too.

    ``measures``: printed_meter (beats, NULL without one), doubtful (the page's reading is weak), label,
    implicit, nominal, content, length, warnings. Doubt is warned of at its first bar and at every bar
    that does not add up, and only while no printed meter is known.
    """
    m = carry_last(measures, keys, [index], F.col("printed_meter"), "__meter", chunk)
    m = running_sum(m, keys, [index], F.when(F.col("doubtful"), 1).otherwise(0).cast("bigint"), "__doubts", chunk)
    m = settle(m, chunk)
    doubt, meter = F.col("__doubts") > 0, F.col("__meter")
    regular = ~F.coalesce("implicit", F.lit(False)) & ~F.startswith(F.col("label"), F.lit("X"))
    fix = meter.isNotNull() & regular & (F.abs(F.col("nominal") - meter) > 1e-6)
    text = F.when(doubt, "Time signature corrected from the printed PDF; the recognized one was read with low confidence."
                  ).otherwise("Time signature corrected from the printed PDF.")
    fits = fix & (F.abs(F.col("content") - meter) <= 1e-6)
    kept = F.when(fits, F.filter("warnings", lambda w: ~F.startswith(w, F.lit("Recognized duration differs")))).otherwise(F.col("warnings"))
    m = m.withColumns({
        "warnings": F.concat(kept, F.array_compact(F.array(F.when(fix, text)))),
        "length": F.when(fix, F.greatest(meter, "content")).otherwise(F.col("length")),
        "nominal": F.when(fix, meter).otherwise(F.col("nominal"))})
    open_doubt = doubt & meter.isNull()
    m = running_sum(m, keys, [index], F.when(open_doubt, 1).otherwise(0).cast("bigint"), "__nth", chunk)
    off = F.abs(F.col("content") - F.col("nominal")) > 1e-6
    warn = open_doubt & ((F.col("__nth") == 1) | off)
    note = ("The printed time signature could not be read confidently and none was recoverable from the PDF; "
            "bar lengths here may be wrong.")
    return m.withColumn("warnings", F.concat("warnings", F.array_compact(F.array(F.when(warn, note))))).drop(
        "__meter", "__doubts", "__nth")


def meter_confirmed(measures: DataFrame, keys: Sequence[str], least: int = 4, share: float = 0.8) -> DataFrame:
    """A-32: pages where enough regular bars add up to the meter that was read."""
    regular = (~F.coalesce("implicit", F.lit(False)) & ~F.startswith(F.col("label"), F.lit("X")) & (F.col("nominal") != 0))
    fits = regular & (F.abs(F.col("content") - F.col("nominal")) <= 1e-6)
    return measures.groupBy(*keys).agg(F.count_if(regular).alias("bars"), F.count_if(fits).alias("fitting")).withColumn(
        "confirmed", (F.col("bars") >= least) & (F.col("fitting") >= F.lit(share) * F.col("bars")))
