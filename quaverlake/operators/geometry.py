"""Page geometry: points, boxes, lines and staves joined by distance.

Positions are PDF points, top-down. ``keys`` names the page (and document) columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.pitch import diatonic_label
from quaverlake.operators.asof import asof_join
from quaverlake.operators.assign import greedy_assign
from quaverlake.operators.bands import band_join, box_join, cell, overlap_join, stab_join
from quaverlake.operators.ranks import top_n_per_key, upper_median
from quaverlake.operators.segments import carry_last, following, islands, previous, running_max, running_min, running_sum, settle
from quaverlake.session import cut_lineage

# Tolerances in points or staff spaces, glyph code points.
MATCH_DISTANCE = 1.5
NEAR_STAFF_SPACES, MAX_LEDGER_SPACES, LEDGER_CLEARANCE = 4.25, 7.0, 1.5
SNAP = 0.24
MIN_CLEF_OVERLAP = 3.0
MIN_GRADE = 0.4
NOTEHEADS = {0xE0A2: "WHOLE_NOTE", 0xE0A3: "NOTEHEAD_VOID", 0xE0A4: "NOTEHEAD_BLACK"}
LINK_DX, LINK_DY = 16.0, 45.0
BAND_PAIRS, BAND_REST = 2, 20
NORMAL_NOTEHEAD = 5.0
DENOMINATORS, PLAIN_DENOMINATORS = (1, 2, 4, 8, 16, 32), (2, 4, 8, 16)


def _center(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2


# --- matching points ---------------------------------------------------------------------------

def link_labels(labels: DataFrame, notes: DataFrame, keys: Sequence[str], eps: float = MATCH_DISTANCE) -> DataFrame:
    """J-11: for each label line (``label_id``, ``x``, ``y``) the notes (``note_id``, ``seq``, ``nx``, ``ny``)
    whose centre lies within ``eps``, once each, in note order.

    Pairs grow with the square of the notes of a page, so none is shuffled: the notes that a label of a grid cell
    can reach are one sorted list, a few times as long as the lists of the result, and each label picks from the
    list of its cell. A note is copied to the cells of its box; copies of a note are listed once.
    """
    size = max(eps, 8.0)
    spread = (notes.withColumn("__cx", F.explode(F.sequence(cell(F.col("nx") - eps, size), cell(F.col("nx") + eps, size))))
              .withColumn("__cy", F.explode(F.sequence(cell(F.col("ny") - eps, size), cell(F.col("ny") + eps, size)))))
    cells = [*keys, "__cx", "__cy"]
    lists = spread.groupBy(*cells).agg(F.array_sort(F.collect_list(F.struct("seq", "note_id", "nx", "ny"))).alias("__notes"))
    near = F.filter("__notes", lambda n: F.sqrt((F.col("x") - n["nx"]) ** 2 + (F.col("y") - n["ny"]) ** 2) <= eps)
    found = F.array_distinct(F.transform(near, lambda n: n["note_id"]))
    return (labels.withColumn("__cx", cell(F.col("x"), size)).withColumn("__cy", cell(F.col("y"), size))
            .join(lists, cells, "left")
            .withColumn("notes", F.coalesce(found, F.array().cast(f"array<{notes.schema['note_id'].dataType.simpleString()}>")))
            .drop("__cx", "__cy", "__notes"))


def uncovered_points(points: DataFrame, boxes: DataFrame, keys: Sequence[str], margin: float = MATCH_DISTANCE,
                     cell_size: float = 32.0) -> DataFrame:
    """J-12: points (``x``, ``y``) inside no box (``x0``..``y1``) grown by ``margin``."""
    grown = (F.col("x0") - margin, F.col("y0") - margin, F.col("x1") + margin, F.col("y1") + margin)
    return box_join(points, boxes.select(*keys, "x0", "y0", "x1", "y1"), keys, "x", "y", grown, cell_size, "left_anti")


def fill_gaps(existing: DataFrame, candidates: DataFrame, keys: Sequence[str], cell_size: float = 32.0) -> DataFrame:
    """J-13: existing heads plus the candidates with no head near them on their staff.

    ``keys`` includes the staff. Near is judged by the candidate's size (``w``, ``h``), so the
    candidate is the box and the existing head the point. Both carry ``head_id``, ``cx``, ``cy``, ``w``, ``h``.
    """
    dx = F.greatest(F.lit(2.0), F.col("c_w") * 0.55)
    boxes = candidates.select(*keys, F.col("head_id").alias("c_id"), F.col("cx").alias("c_x"), F.col("cy").alias("c_y"),
                              F.col("w").alias("c_w"), F.col("h").alias("c_h"))
    bounds = (F.col("c_x") - dx, F.col("c_y") - F.col("c_h") * 0.55, F.col("c_x") + dx, F.col("c_y") + F.col("c_h") * 0.55)
    taken = box_join(existing.select(*keys, "cx", "cy"), boxes, keys, "cx", "cy", bounds, cell_size).select(
        *keys, F.col("c_id").alias("head_id")).distinct()
    fresh = candidates.join(taken, [*keys, "head_id"], "left_anti")
    return (existing.withColumn("added", F.lit(False))
            .unionByName(fresh.select(*existing.columns).withColumn("added", F.lit(True))))


def nearest_with_clearance(points: DataFrame, staves: DataFrame, keys: Sequence[str], point_id: str) -> DataFrame:
    """J-14: the nearest staff (``staff``, ``middle``, ``interline``) of each point's ``y``, in staff spaces.

    Beyond the near limit a point is kept only up to the ledger limit and only if every other staff
    is clearly further. A page has few staves, so the join is as long as points times staves of a
    page; the two nearest are cut before the shuffle.
    """
    d = F.abs(F.col("y") - F.col("middle")) / F.col("interline")
    ranked = top_n_per_key(points.join(staves.filter(F.col("interline") > 0), list(keys)).withColumn("distance", d),
                           [*keys, point_id], [F.col("distance"), F.col("staff")], 2, "__r")
    best = ranked.groupBy(*keys, point_id).agg(
        *[F.max(F.when(F.col("__r") == 1, F.col(c))).alias(c) for c in ("staff", "middle", "interline", "distance")],
        F.max(F.when(F.col("__r") == 2, F.col("distance"))).alias("second"))
    clear = F.col("second").isNull() | (F.col("second") >= F.col("distance") * LEDGER_CLEARANCE)
    return best.filter((F.col("distance") <= NEAR_STAFF_SPACES) | ((F.col("distance") <= MAX_LEDGER_SPACES) & clear))


def place_on_staff(points: DataFrame, staves: DataFrame, keys: Sequence[str], point_id: str) -> DataFrame:
    """J-14 with the staff position: points further than the snap limit from a line or space go."""
    near = points.join(nearest_with_clearance(points, staves, keys, point_id), [*keys, point_id])
    half = F.col("interline") / 2
    placed = near.withColumn("pitch", F.rint((F.col("y") - F.col("middle")) / half).cast("int"))
    off = F.abs(F.col("y") - (F.col("middle") + F.col("pitch") * half))
    return placed.filter(off <= F.col("interline") * SNAP)


def link_by_position(labels: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-15: labels (``label_id``, ``x``, ``y``, ``pc``) to heads (``head_id``, ``hx``, ``hy``, ``hpc``) of the same
    pitch class, one to one, cheapest pair first. Every pair inside the gates competes.

    Pairs grow with the square of the points of a page, so they are made in bands of cost, cheapest first, each
    twice as wide as the one before, and of the points that are left. A pair that is the cheapest of both its
    points in a band is so among all pairs, so the bands together take what one pass over all pairs would; what a
    band leaves undecided is made again in the next.
    """
    by = [*keys, "pc"]
    left = cut_lineage(labels.select(*by, "label_id", "x", "y", (F.col("x") * 2).alias("u")).filter(F.col("label_id").isNotNull()))
    right = cut_lineage(heads.withColumnRenamed("hpc", "pc").select(*by, "head_id", "hx", "hy", (F.col("hx") * 2).alias("hu")))
    dx, dy = F.abs(F.col("hx") - F.col("x")), F.abs(F.col("hy") - F.col("y"))
    most = LINK_DX * 2 + LINK_DY
    rows = left.count()
    limit, taken = _first_band(left, right, by, most, BAND_PAIRS * rows), None
    while True:
        # a little wider than the limit, so that rounding puts no pair into a later band
        reach = [F.lit(min(limit, gate) * 1.001) for gate in (LINK_DX * 2, LINK_DY)]
        near = box_join(left, right, by, "u", "y", (F.col("hu") - reach[0], F.col("hy") - reach[1], F.col("hu") + reach[0],
                                                    F.col("hy") + reach[1]), min(limit, LINK_DY) * 2)
        pairs = (near.filter((dx <= LINK_DX) & (dy <= LINK_DY) & (dx * 2 + dy <= limit))
                 .select(*keys, "head_id", "label_id", (dx * 2 + dy).alias("cost")))
        band = greedy_assign(pairs, "label_id", "head_id", ["cost"], keys, 0 if limit >= most else rows // BAND_REST)
        taken = band if taken is None else taken.unionByName(band)
        if limit >= most:
            return taken
        left = cut_lineage(left.join(band.select(*keys, "label_id"), [*keys, "label_id"], "left_anti"))
        right = cut_lineage(right.join(band.select(*keys, "head_id"), [*keys, "head_id"], "left_anti"))
        limit *= 2


def _first_band(labels: DataFrame, heads: DataFrame, by: Sequence[str], most: float, pairs: int) -> float:
    """``most``, halved until cells as wide hold about ``pairs`` pairs, or halving no longer helps."""
    limit, before = most, float("inf")
    while True:
        def counts(df: DataFrame, u: str, v: str, name: str) -> DataFrame:
            return (df.groupBy(*by, cell(F.col(u), limit).alias("cu"), cell(F.col(v), limit).alias("cv"))
                    .agg(F.count("*").alias(name)))

        met = (counts(labels, "u", "y", "labels").join(counts(heads, "hu", "hy", "heads"), [*by, "cu", "cv"])
               .agg(F.sum(F.col("labels") * F.col("heads"))).first()[0] or 0)
        if met <= pairs or met > 0.75 * before:
            return limit
        limit, before = limit / 2, met


def dedup_positions(df: DataFrame, keys: Sequence[str], seq: str, x: str = "x", y: str = "y",
                    digits: int = 1) -> DataFrame:
    """D-02: one row per rounded position, the first by ``seq``. A combined aggregate, so copies of
    one position are never gathered."""
    row = F.struct(*df.columns)
    return (df.groupBy(*keys, F.bround(x, digits).alias("__x"), F.bround(y, digits).alias("__y"))
            .agg(F.min_by(row, F.col(seq)).alias("__row")).select("__row.*"))


def confident(df: DataFrame, min_grade: float = MIN_GRADE) -> DataFrame:
    """P-16: rows whose grade, where there is one, is high enough."""
    return df.filter(F.coalesce(F.col("grade"), F.lit(1.0)) >= min_grade)


def weakest_inside(pairs: DataFrame, digits: DataFrame, keys: Sequence[str], slack: float = 2.0,
                   cell_size: float = 64.0) -> DataFrame:
    """J-17: the grade of a meter (``pair_id``, ``x``, ``w``, ``grade``) is its weakest digit's (``dx``, ``digit_grade``)
    between its bounds; its own where it holds none. Adds ``low_confidence`` (P-16)."""
    spans = pairs.select(*keys, "pair_id", "x", "w")
    inside = stab_join(digits, spans, keys, "dx", F.col("x") - slack, F.col("x") + F.col("w") + slack, cell_size,
                       closed_right=True)
    worst = inside.groupBy(*keys, "pair_id").agg(F.min("digit_grade").alias("__worst"))
    return (pairs.join(worst, [*keys, "pair_id"], "left")
            .withColumn("grade", F.coalesce("__worst", "grade", F.lit(1.0))).drop("__worst")
            .withColumn("low_confidence", F.col("grade") < MIN_GRADE))


def max_overlap(glyphs: DataFrame, staves: DataFrame, keys: Sequence[str], glyph_id: str,
                least: float = MIN_CLEF_OVERLAP, cell_size: float = 64.0) -> DataFrame:
    """J-18: the staff (``staff``, ``top``, ``bottom``) a glyph (``y0``, ``y1``) overlaps most, at least ``least``."""
    overlap = F.greatest(F.lit(0.0), F.least("y1", "bottom") - F.greatest("y0", "top"))
    pairs = overlap_join(glyphs.select(*keys, glyph_id, "y0", "y1"), staves.select(*keys, "staff", "top", "bottom"), keys,
                         (F.col("y0"), F.col("y1")), (F.col("top"), F.col("bottom")), cell_size)
    best = (pairs.withColumn("overlap", overlap).filter(F.col("overlap") >= least).groupBy(*keys, glyph_id)
            .agg(F.max_by(F.struct("staff", "overlap"), F.struct("overlap", -F.col("staff"))).alias("b")))
    return best.select(*keys, glyph_id, "b.staff", "b.overlap")


def restore_scale(df: DataFrame, scales: DataFrame, keys: Sequence[str], columns: Sequence[str] = (),
                  boxes: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """J-26: coordinates back at the upload's page size; single values are rounded, boxes are not.

    ``scales`` has a row per page, so it grows with the documents and is joined by key.
    """
    out = df.join(scales.select(*keys, F.col("scale").alias("__s")), list(keys), "left")
    s = F.coalesce(F.col("__s"), F.lit(1.0))
    out = out.withColumns({c: F.bround(F.col(c) / s, digits) for c in columns})
    return out.withColumns({b: F.transform(F.col(b), lambda v: v / F.coalesce(F.col("__s"), F.lit(1.0))) for b in boxes}
                           ).drop("__s")


# --- marks and lines ---------------------------------------------------------------------------

def place_marks(marks: DataFrame, regions: DataFrame, notes: DataFrame, keys: Sequence[str],
                reach: float = 100.0) -> DataFrame:
    """J-27: a tempo mark (``mark_id``, ``x``, ``y``) takes the system next below within ``reach``, there the
    first region ending right of it, and in that the earliest onset not left of it (0 if none).

    ``regions``: system, slot, x1, staff_top. ``notes``: system, slot, x0, onset.
    """
    tops = regions.groupBy(*keys, "system").agg(F.min("staff_top").alias("top"))
    below = band_join(marks, tops, keys, "y", "top", reach, (F.col("top") > F.col("y")) & (F.col("top") - F.col("y") <= reach))
    system = below.groupBy(*keys, "mark_id").agg(F.min_by(F.struct("system", "x"), F.struct("top", "system")).alias("s"))
    at = system.select(*keys, "mark_id", "s.system", "s.x")
    region = (at.join(regions.select(*keys, "system", "slot", "x1"), [*keys, "system"]).filter(F.col("x1") >= F.col("x"))
              .groupBy(*keys, "mark_id").agg(F.min("slot").alias("slot"), F.first("system").alias("system"),
                                             F.first("x").alias("x")))
    onset = F.min(F.when(F.col("x0") >= F.col("x") - 3, F.col("onset")))
    return (region.join(notes.select(*keys, "system", "slot", "x0", "onset"), [*keys, "system", "slot"], "left")
            .groupBy(*keys, "mark_id", "system", "slot").agg(F.coalesce(onset, F.lit(0.0)).alias("beat")))


def assign_lines(lines: DataFrame, staves: DataFrame, keys: Sequence[str], reach: float = 65.0,
                 margin: float = 3.0) -> DataFrame:
    """J-28: an octave line (``line_id``, ``y``, ``direction``: 1 up, -1 down, NULL unknown) belongs to the nearest
    staff (``staff``, ``top``, ``bottom``) it can belong to, within ``reach`` and unless another is as near.

    A line above a staff shifts up, one below shifts down. Adds ``sign``.
    """
    above = (F.coalesce("direction", F.lit(1)) != -1) & (F.col("y") < F.col("top"))
    under = (F.coalesce("direction", F.lit(-1)) != 1) & (F.col("y") > F.col("bottom"))
    distance = F.when(above, F.col("top") - F.col("y")).when(under, F.col("y") - F.col("bottom"))
    # The second nearest matters only up to reach + margin, which bounds the band.
    wide = reach + margin
    edges = staves.select(*keys, "staff", "top", "bottom")
    up = band_join(lines, edges, keys, "y", "top", wide, above & (F.col("top") - F.col("y") <= wide))
    down = band_join(lines, edges, keys, "y", "bottom", wide, under & (F.col("y") - F.col("bottom") <= wide))
    both = up.unionByName(down).withColumn("distance", distance).withColumn("sign", F.when(above, 1).otherwise(-1))
    two = top_n_per_key(both, [*keys, "line_id"], [F.col("distance"), F.col("staff")], 2, "__r")
    best = two.groupBy(*keys, "line_id").agg(
        *[F.max(F.when(F.col("__r") == 1, F.col(c))).alias(c) for c in ("staff", "distance", "sign")],
        F.max(F.when(F.col("__r") == 2, F.col("distance"))).alias("__second"))
    clear = F.col("__second").isNull() | (F.col("__second") - F.col("distance") >= margin)
    return best.filter((F.col("distance") <= reach) & clear).drop("__second")


def covering_sum(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str = "x", chunk_width: float | None = None) -> DataFrame:
    """J-29: the sum of ``amount`` over every interval (``left``, ``right``, closed) a point lies in, 0 where there is none.

    A sweep: an interval adds its amount where it opens and takes it back behind where it closes, and a point reads the running sum. Rows are the
    points and two for each interval, however many overlap. Whole numbers and decimals are summed exactly; doubles as decimals of ten places.
    Points without a position and intervals that end before they begin take no part; a missing amount counts as 0.
    """
    kind = intervals.schema["amount"].dataType.simpleString()
    amount = F.coalesce("amount", F.lit(0))
    amount = amount.cast("decimal(38,10)") if kind in ("double", "float") else amount
    zero = F.lit(0).cast("decimal(38,10)" if kind in ("double", "float") else kind)
    real = intervals.where(F.col("left") <= F.col("right"))
    payload = F.struct(*[F.col(c) for c in points.columns if c not in keys]).alias("__row")
    rows = points.select(*keys, F.col(at).cast("double").alias("__pos"), F.lit(1).alias("__side"), zero.alias("__amount"), payload)
    marks = real.select(*keys, F.explode(F.array(F.struct(F.col("left").cast("double").alias("pos"), F.lit(0).alias("side"), amount.alias("amount")),
                                                 F.struct(F.col("right").cast("double").alias("pos"), F.lit(2).alias("side"), (-amount).alias("amount")))).alias("m"))
    marks = marks.select(*keys, F.col("m.pos").alias("__pos"), F.col("m.side").alias("__side"), F.col("m.amount").alias("__amount"), F.lit(None).alias("__row"))
    chunk = None if chunk_width is None else F.floor(F.col("__pos") / chunk_width).cast("bigint")
    swept = running_sum(rows.unionByName(marks), keys, ["__pos", "__side"], F.col("__amount"), "__sum", chunk).where("__side = 1")
    shift = F.when(F.col("__pos").isNull(), zero).otherwise(F.col("__sum"))
    return swept.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in points.columns], (shift.cast(kind) if kind in ("double", "float") else shift).alias("shift"))


def printed_accidental(heads: DataFrame, marks: DataFrame, keys: Sequence[str], chunk_width: float | None = None) -> DataFrame:
    """J-33: the accidental drawn for each head: on its line (part of ``keys``), left of it, and right of the
    head before it there, or of four spaces where none is.

    ``heads``: head_id, x0, x1, interline. ``marks``: shape, m0, m1. Both halves are carries along
    the line: the last right edge before the head, and the rightmost mark that ends in time.
    """
    edges = heads.select(*keys, F.col("x1").alias("x0"), F.col("x1").alias("__edge"))
    left = asof_join(heads, edges, keys, "x0", ["__edge"], chunk_width=chunk_width)
    left = left.withColumn("__floor", F.coalesce("__edge", F.col("x0") - 4 * F.col("interline"))).withColumn(
        "__bound", F.col("x0") + F.col("interline") * 0.2)
    names = left.columns
    mark = F.struct(F.col("m0"), F.col("shape"))
    a = left.select(*keys, F.col("__bound").alias("__pos"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"),
                    F.lit(None).alias("__mark"))
    b = marks.select(*keys, F.col("m1").alias("__pos"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), mark.alias("__mark"))
    chunk = F.floor(F.col("__pos") / F.lit(chunk_width)).cast("bigint") if chunk_width else None
    run = running_max(a.unionByName(b), keys, ["__pos", "__side"], F.col("__mark"), "__best", chunk)
    rows = run.filter(F.col("__row").isNotNull()).select("__row.*", "__best")
    return (rows.withColumn("accidental", F.when(F.col("__best.m0") >= F.col("__floor"), F.col("__best.shape")))
            .drop("__best", "__edge", "__floor", "__bound"))


def stack_digits(groups: DataFrame, keys: Sequence[str], below: DataFrame | None = None) -> DataFrame:
    """J-34: stacked digit groups (``group_id``, ``x``, ``right``, ``y``, ``text``, ``plain``) as meters.

    The lower group must be the only one 4 to 20 points below and centred; plain digits are weaker
    evidence, so only common denominators count there.
    """
    upper = groups.select(*keys, *[F.col(c) for c in ("group_id", "x", "right", "y", "text", "plain")])
    lower = (groups if below is None else below).select(*keys, F.col("x").alias("lx"), F.col("right").alias("lr"), F.col("y").alias("ly"),
                          F.col("text").alias("ltext"))
    gap = F.col("ly") - F.col("y")
    ok = (gap > 4) & (gap < 20) & (F.abs((F.col("lx") + F.col("lr") - F.col("x") - F.col("right")) / 2) < 5)
    pairs = band_join(upper, lower, keys, "y", "ly", 20.0, ok)
    single = pairs.groupBy(*keys, "group_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("x", "y", "text", "ly", "ltext")],
        F.bool_or("plain").alias("plain")).filter(F.col("n") == 1)
    num, den = F.col("text").cast("int"), F.col("ltext").cast("int")
    good = F.when(F.col("plain"), den.isin(*PLAIN_DENOMINATORS)).otherwise(den.isin(*DENOMINATORS))
    return (single.filter(num.between(1, 32) & good)
            .select(*keys, "group_id", "x", _center("y", "ly").alias("y"), (num * 4 / den).alias("beats")))


def discount_text_marks(marks: DataFrame, words: DataFrame, staves: DataFrame, keys: Sequence[str],
                        octave_word: str, cell_size: float = 32.0) -> DataFrame:
    """J-35: where on each staff octave marks stop being believed, because one there is really a word.

    ``marks``: mark_id, staff and a box; ``words``: text and a box; ``staves``: staff, system, role. A
    mark over a word that spells an octave sign stays. The doubt starts at the mark on its staff
    (``from_x``) and at 0 on the same role's staff in every later system.
    """
    pair = overlap_join(marks.select(*keys, "mark_id", "x0", "y0", "x1", "y1"),
                        words.select(*keys, "word", *[F.col(c).alias(f"w{c}") for c in ("x0", "y0", "x1", "y1")]), keys,
                        (F.col("x0"), F.col("x1")), (F.col("wx0"), F.col("wx1")), cell_size, strict=True,
                        also=((F.col("y0"), F.col("y1")), (F.col("wy0"), F.col("wy1"))))
    verdict = pair.groupBy(*keys, "mark_id").agg(
        F.bool_or(F.col("word").rlike(octave_word)).alias("octave"),
        F.bool_or(F.col("word").rlike(r"[\p{L}\p{N}&&[\x{0}-\x{1FFF}]]")).alias("text"))
    wrong = marks.join(verdict.filter(F.col("text") & ~F.col("octave")), [*keys, "mark_id"], "left_semi")
    own = wrong.select(*keys, "staff", F.col("x0").alias("from_x"))
    placed = wrong.join(staves, [*keys, "staff"]).groupBy(*keys, "role").agg(F.min("system").alias("first"))
    later = (staves.join(placed, [*keys, "role"]).filter(F.col("system") > F.col("first"))
             .select(*keys, "staff", F.lit(0.0).alias("from_x")))
    return own.unionByName(later).groupBy(*keys, "staff").agg(F.min("from_x").alias("from_x"))


def carry_direction(marks: DataFrame, keys: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """W-23: fill unknown directions of octave marks from their neighbours in reading order.

    ``marks``: y, x, direction (NULL unknown), sign (what the staff says, NULL where none is in reach), ``one_line``
    (has exactly one line), ``at_edge`` (that line reaches the right edge), ``label_at_edge``. A mark
    whose line runs off its system takes the direction of the mark that continues it further
    left; otherwise the last mark's sign carries on while it reached the right edge.
    """
    order = ["y", "x"]
    # Backwards: a chain of unknown marks that each run off and continue further left.
    nxt = following(marks, keys, order, {"__nx": "x", "__nd": "direction"}, chunk)
    takes = (F.col("direction").isNull() & F.col("one_line") & F.col("at_edge") & (F.col("__nx") < F.col("x")))
    linked = nxt.withColumn("__takes", F.coalesce(takes, F.lit(False)))
    # A run is closed by its last mark, the first one that takes nothing: its direction is the run's.
    opens = previous(linked, keys, order, {"__pt": "__takes"}, chunk)
    runs = islands(opens, keys, order, ~F.coalesce(F.col("__pt"), F.lit(False)), "__run", chunk)
    runs = settle(runs, chunk)
    ends = runs.filter(~F.col("__takes")).select(*keys, "__run", F.col("direction").alias("__rd"))
    back = (runs.join(ends, [*keys, "__run"], "left").withColumn("direction", F.coalesce("direction", "__rd"))
            .drop("__rd", "__run", "__pt", "__takes", "__nx", "__nd"))
    # Forwards: what the mark before hands on. A mark of unknown direction that reaches the edge
    # hands on what it was given, else its own sign; any other mark sets or clears the state. A line
    # that belongs to no staff clears it.
    reaches = (F.col("one_line") & F.col("at_edge")) | (~F.col("one_line") & F.col("label_at_edge"))
    passing = F.coalesce(F.col("direction").isNull() & reaches & (~F.col("one_line") | F.col("sign").isNotNull()), F.lit(False))
    sets = F.when(reaches, F.when(F.col("one_line"), F.col("sign")).otherwise(F.col("direction")))
    rows = back.withColumn("__pass", passing).withColumn("__set", F.when(~passing, F.struct(sets.alias("v"))))
    rows = islands(rows, keys, order, ~F.col("__pass"), "__seg", chunk)
    first = F.when(F.col("__pass") & F.col("one_line") & F.col("sign").isNotNull(), F.struct(*order, "sign"))
    rows = settle(rows, chunk)
    rows = running_min(rows, [*keys, "__seg"], order, first, "__first", chunk)
    rows = carry_last(rows, keys, order, F.col("__set"), "__held", chunk)
    handed = rows.withColumn("__hand", F.struct(F.coalesce(F.col("__held.v"), F.col("__first.sign")).alias("h")))
    done = previous(settle(handed, chunk), keys, order, {"__given": "__hand"}, chunk)
    return (done.withColumn("direction", F.coalesce("direction", F.col("__given.h")))
            .drop("__pass", "__set", "__seg", "__first", "__held", "__hand", "__given"))


# --- staves and glyphs -------------------------------------------------------------------------

def _halo(df: DataFrame, keys: Sequence[str], y: str, width: float, halo: float) -> DataFrame:
    """Rows in stretches of ``width``, each stretch with a copy of the first ``halo`` of the next."""
    own = F.floor(F.col(y) / width).cast("bigint")
    inside = F.col(y) - own * F.lit(width) < halo
    copies = F.when(inside, F.array(own, own - 1)).otherwise(F.array(own))
    return df.withColumn("__own", own).withColumn("__chunk", F.explode(copies)).withColumn(
        "__mine", F.col("__own") == F.col("__chunk"))


def line_gaps(lines: DataFrame, keys: Sequence[str], y: str = "y", width: float = 256.0) -> DataFrame:
    """The steps between neighbouring distinct line positions that can be inside one staff (2 to 15)."""
    from pyspark.sql import Window as W
    ys = lines.groupBy(*keys, F.bround(y, 2).alias("y")).agg(F.lit(1).alias("__1")).drop("__1")
    w = W.partitionBy(*keys, "__chunk").orderBy("y")
    stepped = _halo(ys, keys, "y", width, 16.0).withColumn("gap", F.lead("y").over(w) - F.col("y"))
    return stepped.filter(F.col("__mine") & (F.col("gap") > 2) & (F.col("gap") < 15)).select(*keys, "y", "gap")


def interline(lines: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """A-28: the median step between neighbouring lines of a page, over steps inside a staff."""
    from quaverlake.operators.ranks import exact_median
    return exact_median(line_gaps(lines, keys, y), "gap", keys, "interline")


def five_line_groups(lines: DataFrame, keys: Sequence[str], y: str = "y", width: float = 512.0) -> DataFrame:
    """A-28: five neighbouring lines with even steps as a staff: ``middle`` and ``interline``.

    Five lines span less than 60 points, so a stretch with that much of the next one sees every
    group that starts in it.
    """
    from pyspark.sql import Window as W
    ys = lines.groupBy(*keys, F.bround(y, 2).alias("y")).agg(F.lit(1).alias("__1")).drop("__1")
    w = W.partitionBy(*keys, "__chunk").orderBy("y")
    rows = _halo(ys, keys, "y", width, 80.0).withColumns({f"__y{i}": F.lead("y", i).over(w) for i in range(1, 5)})
    ends = ["y", "__y1", "__y2", "__y3", "__y4"]
    gaps = [F.col(b) - F.col(a) for a, b in zip(ends, ends[1:])]
    even = (F.greatest(*gaps) - F.least(*gaps) < 1.0) & (gaps[0] > 2) & (gaps[0] < 15) & F.col("__y4").isNotNull()
    return rows.filter(F.col("__mine") & even).select(*keys, F.col("__y2").alias("middle"),
                                                      ((F.col("__y4") - F.col("y")) / 4).alias("interline"))


def infer_glyph(glyphs: DataFrame, staves: DataFrame, keys: Sequence[str], share: float = 0.7) -> DataFrame:
    """A-39: the printed noteheads of each page and the evidence used.

    Standard noteheads (``codepoint``) are counted directly. Otherwise the most frequent glyph with
    at least ``share`` of its places on a half space of a staff is taken for the notehead; such a
    staff is the page's first within 4.3 spaces.
    """
    std = glyphs.groupBy(*keys).agg(F.count_if(F.col("codepoint").isin(*NOTEHEADS)).alias("direct"))
    g = glyphs.select(*keys, "glyph_id", "codepoint", "y")
    reach = 4.3 * 15.0
    near = band_join(g, staves.select(*keys, "staff", "middle", "interline"), keys, "y", "middle", reach,
                     F.abs(F.col("y") - F.col("middle")) <= F.col("interline") * 4.3)
    steps = (F.col("y") - F.col("middle")) / (F.col("interline") / 2)
    first = near.groupBy(*keys, "glyph_id").agg(F.min_by(steps, F.col("staff")).alias("steps"))
    on = first.filter(F.abs(F.col("steps") - F.rint("steps")) < 0.22).select(*keys, "glyph_id", F.lit(1).alias("__on"))
    per = (g.join(on, [*keys, "glyph_id"], "left").groupBy(*keys, "codepoint")
           .agg(F.count(F.lit(1)).alias("n"), F.count("__on").alias("hits")))
    best = (per.filter(F.col("hits") >= F.col("n") * share).groupBy(*keys)
            .agg(F.max(F.struct("n", "codepoint")).alias("b")))
    return (std.join(best, list(keys), "left")
            .select(*keys, F.when(F.col("direct") > 0, F.col("direct")).otherwise(F.col("b.n")).alias("printed"),
                    F.when(F.col("direct") > 0, None).otherwise(F.col("b.codepoint")).alias("inferred")))


# --- label groups ------------------------------------------------------------------------------

def page_scale_factor(heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-33: per page the upper medians of head widths (``w``, pixels, and ``w_pt``) and the shrink of
    small engraving."""
    medians = upper_median(heads, "w", keys, "median_w").join(upper_median(heads, "w_pt", keys, "median_pt"), list(keys), "full")
    return medians.withColumn("engraving", F.least(F.lit(1.0), F.coalesce(F.col("median_pt") / NORMAL_NOTEHEAD, F.lit(1.0))))


def label_scale(width: Column, median: Column, engraving: Column) -> Column:
    """A-33: a label's scale, .65 to 1 by its head width, then the page's shrink."""
    own = F.greatest(F.lit(0.65), F.least(F.lit(1.0), width / median))
    return F.when(F.coalesce(median, F.lit(0)) != 0, own).otherwise(1.0) * engraving


def label_groups(notes: DataFrame, keys: Sequence[str] = ("page", "staff", "chord_id")) -> DataFrame:
    """A-34: simultaneous notes as one label record: centre, top, bottom, mean width, pitches and
    letters from low numbers (high pitches) on. A chord holds the notes of two hands at most."""
    pitch = F.struct(F.col("diatonic"), (-F.col("alter")).alias("minus_alter"))
    cx, cy = _center("x0", "x1"), _center("y0", "y1")
    grouped = notes.groupBy(*keys).agg(
        F.min("measure").alias("measure"), F.avg(cx).alias("anchor_x"), F.min(cy).alias("top_y"), F.max(cy).alias("bottom_y"),
        F.avg(F.col("x1") - F.col("x0")).alias("head_w"), F.array_sort(F.collect_list(pitch)).alias("pitches"))
    letters = F.transform("pitches", lambda p: diatonic_label(p["diatonic"], -p["minus_alter"]))
    return grouped.withColumn("letters", letters)


def suppress_repeats(groups: DataFrame, keys: Sequence[str] = ("page", "staff", "measure")) -> DataFrame:
    """A-35: of equal chords (two notes up) in a bar only the first by position stays."""
    chords, single = groups.filter(F.size("pitches") > 1), groups.filter(F.size("pitches") <= 1)
    first = chords.groupBy(*keys, "pitches").agg(F.min_by(F.struct(*groups.columns), F.struct("anchor_x", "chord_id")).alias("r"))
    return single.unionByName(first.select("r.*"))
