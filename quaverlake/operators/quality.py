"""Recognition quality: funnels, page verdicts, re-reads, timeline reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.operators.ranks import top_n_per_key

# Warning groups and thresholds.
INFORMATIONAL = ("Fermatas use", "Grace timing uses a short lead-in", "Arpeggio read from the printed PDF",
                 "Inferred pickup length", "Time signature corrected from the printed PDF",
                 "Ending brackets without a recognized repeat", "Recovered a missed notehead",
                 "Recovered note attacks omitted")
CARRIED = ("The printed time signature could not be read confidently",)
SHEET_FAILURE = "PDF note matching failed"
PROBLEM_RATIO, PROBLEM_MIN, UNMATCHED_RATIO = 0.3, 5, 0.05
SPARSE_HEADS_PER_STAFF, SPARSE_MIN_STAVES, SPARSE_RATIO, SPARSE_MIN_MEDIAN = 8, 2, 0.4, 20
MIN_AGREEMENT, MIN_EXPORT_RATIO, MIN_VECTOR_HEADS = 0.85, 0.85, 40
MIN_PLACED, MIN_HEADS_FOR_RHYTHM = 0.90, 40
PLACED_GAIN, QUALITY_GAIN, BAR_GROWTH, EXTRA_UNVERIFIED, KEEP_HEADS = 0.03, 0.03, 2.0, 2, 0.9
HELPED_BY_DPI = 1.05
SECONDS_PER_MEGAPIXEL, SINGLE_PAGE_OVERHEAD = 1.6, 1.75
DEFAULT_DPI, RETRY_DPI = 300, 400
MAX_PAGE_POINTS, A4_POINTS = 200 * 72 * 72, 595 * 842


def starts_with_any(col: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(col, F.lit(p))
    return out


# --- timeline reports ----------------------------------------------------------------------------

def timeline_quality(docs: DataFrame, informational: Sequence[str] = INFORMATIONAL, carried: Sequence[str] = CARRIED,
                     problem_ratio: float = PROBLEM_RATIO, problem_min: int = PROBLEM_MIN,
                     unmatched_ratio: float = UNMATCHED_RATIO) -> DataFrame:
    """A-22, A-23: quality figures and reasons of each timeline document.

    ``docs``: measures ARRAY<STRUCT<warnings ARRAY<STRING>>>, stats MAP<STRING,BIGINT>, warnings, missing BOOLEAN.
    A document is one row, so everything is computed inside the row, without a shuffle.
    """
    def is_local(w: Column) -> Column:
        return ~starts_with_any(w, informational) & ~starts_with_any(w, carried)

    none = F.array().cast("array<string>")
    measures = F.col("measures")
    n = F.coalesce(F.when(measures.isNotNull(), F.size(measures)), F.lit(0))
    problems = F.coalesce(F.size(F.filter(measures, lambda m: F.exists(F.coalesce(m["warnings"], none), is_local))), F.lit(0))

    def stat(name: str) -> Column:
        return F.coalesce(F.try_element_at("stats", F.lit(name)), F.lit(0))

    base = docs.withColumns({
        "n_measures": n, "problem_measures": F.when(measures.isNotNull(), problems).otherwise(0),
        "notes_unmatched": stat("notes_unmatched"), "n_notes": stat("notes_matched") + stat("notes_unmatched"),
        "pages_without_regions": stat("pages_without_regions"),
        "sheet_warnings": sheet_warnings_of(measures, F.col("warnings"), informational, carried)})
    m, p, nn, u = (F.col(c) for c in ("n_measures", "problem_measures", "n_notes", "notes_unmatched"))
    pages = F.col("pages_without_regions")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    reasons = [
        F.when(F.coalesce(F.col("missing"), F.lit(False)), "No playback timeline was produced, so practice mode is unavailable"),
        F.when((m > 0) & (p >= problem_min) & (p / m >= problem_ratio), text(p, " of ", m, " measures have recognition warnings")),
        F.when((nn > 0) & (u / nn >= unmatched_ratio), text(u, " of ", nn, " notes could not be matched to the printed page")),
        F.when(pages != 0, text(pages, " page(s) have no recognized measures")),
        F.when(F.exists("sheet_warnings", lambda w: F.startswith(w, F.lit(SHEET_FAILURE))),
               "PDF note matching failed for the whole sheet")]
    return base.withColumn("reasons", F.array_compact(F.array(*reasons)))


def sheet_warnings_of(measures: Column, warnings: Column, informational: Sequence[str] = INFORMATIONAL,
                      carried: Sequence[str] = CARRIED) -> Column:
    """A-23: the document's own warnings, then each carried one once."""
    none = F.array().cast("array<string>")
    own = F.coalesce(warnings, none)
    repeated = F.array_distinct(F.flatten(F.transform(
        F.coalesce(measures, F.array()), lambda m: F.filter(F.coalesce(m["warnings"], none), lambda w:
                                                            starts_with_any(w, carried) & ~starts_with_any(w, informational)))))
    return F.concat(F.filter(own, lambda w: ~starts_with_any(w, informational)),
                    F.coalesce(F.filter(repeated, lambda w: ~F.array_contains(own, w)), none))


def sheet_warnings(docs: DataFrame, informational: Sequence[str] = INFORMATIONAL,
                   carried: Sequence[str] = CARRIED) -> DataFrame:
    """A-23 as a column."""
    return docs.withColumn("sheet_warnings", sheet_warnings_of(F.col("measures"), F.col("warnings"), informational, carried))


def top_warnings(warnings: DataFrame, keys: Sequence[str] = ("doc_id",), k: int = 5,
                 informational: Sequence[str] = INFORMATIONAL, carried: Sequence[str] = CARRIED) -> DataFrame:
    """T-02: the ``k`` most frequent local warnings of each document, first seen first on ties.

    ``warnings``: keys, position, warning. Counts are combined before the shuffle and cut per key.
    """
    local = warnings.filter(~starts_with_any(F.col("warning"), informational) & ~starts_with_any(F.col("warning"), carried))
    counts = local.groupBy(*keys, "warning").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_seen"))
    return top_n_per_key(counts, keys, [F.col("n").desc(), F.col("first_seen")], k)


# --- page verdicts -------------------------------------------------------------------------------

def placed_ratio(heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-24: heads and heads given a time, per page."""
    return (heads.groupBy(*keys).agg(F.count(F.lit(1)).alias("heads"), F.count("onset").alias("placed"))
            .withColumn("ratio", F.col("placed") / F.col("heads")))


def recognition_quality(heads: DataFrame, notes: DataFrame, measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-25: .4 confidence + .25 agreement + .2 in range + .15 rhythm, per page.

    ``heads``: confidence. ``notes``: midi. ``measures``: content, nominal, implicit. Each input is
    reduced to a row per page first; the three are added up as one union, so one shuffle suffices.
    """
    zero = F.lit(None).cast("double")
    h = heads.select(*keys, F.lit(1).alias("h"), F.coalesce("confidence", F.lit(0.0)).alias("c"), zero.alias("n"),
                     zero.alias("r"), zero.alias("m"), zero.alias("f"))
    n = notes.select(*keys, zero.alias("h"), zero.alias("c"), F.lit(1).alias("n"),
                     F.col("midi").between(21, 108).cast("int").alias("r"), zero.alias("m"), zero.alias("f"))
    fits = (F.abs(F.col("content") - F.col("nominal")) < 1e-6) | F.coalesce(F.col("implicit"), F.lit(False))
    m = measures.select(*keys, zero.alias("h"), zero.alias("c"), zero.alias("n"), zero.alias("r"), F.lit(1).alias("m"),
                        fits.cast("int").alias("f"))
    agg = h.unionByName(n).unionByName(m).groupBy(*keys).agg(
        F.coalesce(F.avg("c"), F.lit(0.0)).alias("confidence"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("h", "n", "r", "m", "f")])
    agreement = F.least("h", "n") / F.greatest(F.lit(1), F.col("h"), F.col("n"))
    return agg.select(*keys, (0.4 * F.col("confidence") + 0.25 * agreement
                              + 0.2 * F.col("r") / F.greatest(F.lit(1), F.col("n"))
                              + 0.15 * F.col("f") / F.greatest(F.lit(1), F.col("m"))).alias("quality"))


def sparse_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A-26: which pages look incomplete, and by which rules.

    ``pages``: page, heads, staves, placed, exported (NULL without an export), printed (NULL for a
    scan), empty_bars, read. The median of a document's read pages keeps a counter per distinct
    number of heads. Adds ``rules`` (empty when fine) and the severity columns of T-03.
    """
    med = pages.filter("read").groupBy(doc).agg(F.median("heads").alias("__med"), F.count(F.lit(1)).alias("__n"))
    p = pages.join(med, doc, "left")
    agreement = F.least("heads", "exported") / F.greatest(F.lit(1), F.col("heads"), F.col("exported"))
    vector = F.when(F.col("printed") >= MIN_VECTOR_HEADS, F.col("exported") / F.col("printed"))
    placed = F.when(F.col("heads") >= MIN_HEADS_FOR_RHYTHM, F.col("placed") / F.col("heads"))
    p = p.withColumns({"agreement": agreement, "vector_agreement": vector, "placed_ratio": placed})
    rules = [
        F.when((F.col("staves") >= SPARSE_MIN_STAVES) & (F.col("heads") < SPARSE_HEADS_PER_STAFF * F.col("staves")), "thin"),
        F.when(F.col("placed_ratio") < MIN_PLACED, "unplaced"),
        F.when((F.col("heads") > 0) & (F.col("agreement") < MIN_AGREEMENT), "disagrees"),
        F.when(F.col("vector_agreement") < MIN_EXPORT_RATIO, "unexported"),
        F.when(F.col("exported").isNotNull() & F.col("empty_bars"), "empty bar"),
        F.when((F.col("__n") >= 2) & (F.col("__med") >= SPARSE_MIN_MEDIAN) & (F.col("heads") < SPARSE_RATIO * F.col("__med")),
               "below median")]
    found = F.when(F.col("read"), F.array_compact(F.array(*rules))).otherwise(F.array().cast("array<string>"))
    worst = F.least(F.coalesce("agreement", F.lit(1.0)), F.coalesce("placed_ratio", F.lit(1.0)),
                    F.coalesce("vector_agreement", F.lit(1.0)))
    severity = F.when(F.col("staves") == 0, F.struct(F.lit(1).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("c"))).otherwise(
        F.struct(F.when(F.col("empty_bars") & F.col("exported").isNotNull(), 0).otherwise(1).alias("a"), worst.alias("b"),
                 (F.col("heads") / F.col("staves")).alias("c")))
    return p.withColumn("rules", found).withColumn("severity", severity).drop("__med", "__n")


def worst_pages(flagged: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """T-03: the ``k`` worst flagged pages of each document, back in page order."""
    bad = flagged.filter(F.size("rules") > 0)
    return top_n_per_key(bad, [doc], [F.col("severity"), F.col("page")], k, "place").orderBy(doc, "page")


def staff_gaps(systems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-27: staves missing against the fullest system, and systems of one staff."""
    return systems.groupBy(*keys).agg(
        (F.max("size") * F.count(F.lit(1)) - F.sum("size")).alias("missing_staves"),
        F.count_if(F.col("size") == 1).alias("lone_staves"))


def recovered_more(new, old) -> Column:
    """A-29: whether a re-read (struct or row columns) earned its place over the old scores.

    The vetoes come first: heads lost, fewer heads placed, bars grown apart, known positions lost or
    many unverified notes added. Then one gain must be shown.
    """
    positioned = old["positioned"].isNotNull()
    gain = new["positioned"] - old["positioned"]
    extra = new["unverified"] - old["unverified"]
    allowed = F.greatest(F.lit(EXTRA_UNVERIFIED), gain)
    veto = ((new["count"] < old["count"] * KEEP_HEADS) | (new["placed"] < old["placed"] - PLACED_GAIN)
            | ((old["longest_bar"] != 0) & (new["longest_bar"] > old["longest_bar"] * BAR_GROWTH))
            | (positioned & new["positioned"].isNull())
            | F.coalesce(positioned & ((gain < 0) | (extra > allowed)), F.lit(False)))
    better = ((new["placed"] >= old["placed"] + PLACED_GAIN)
              | ((new["count"] > old["count"]) & (new["quality"] >= old["quality"] - QUALITY_GAIN))
              | ((new["placed"] >= old["placed"]) & (new["quality"] >= old["quality"] + QUALITY_GAIN)))
    return ~veto & better


def longest_bar(measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-29: the longest written bar of each page."""
    return measures.groupBy(*keys).agg(F.max("content").alias("longest_bar"))


SCORES = ("count", "placed", "longest_bar", "quality", "positioned", "unverified")


def accept_reread(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-29 over tables: one verdict per page."""
    n = new.select(*keys, F.struct(*SCORES).alias("new"))
    o = old.select(*keys, F.struct(*SCORES).alias("old"))
    return n.join(o, list(keys)).withColumn("accepted", recovered_more(F.col("new"), F.col("old")))


def choose_variants(original: DataFrame, variants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-30: per page the variant kept after judging each, in order, against the best so far.

    ``variants``: index, uses_dpi and the scores. A page has four at most, so its array is small. A
    page already recovered takes no more; after a higher resolution that showed no new heads the
    next one of that kind is passed over.
    """
    score = ", ".join(f"{c}: double" for c in SCORES)
    scores = F.struct(*[F.col(c).cast("double").alias(c) for c in SCORES])
    listed = variants.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("index").cast("int").alias("index"), "uses_dpi", scores.alias("s")))).alias("__v"))
    base = original.select(*keys, scores.alias("__o"))
    state = f"struct<best: struct<{score}>, kept: int, helped: boolean>"
    start = F.struct(F.col("__o").alias("best"), F.lit(None).cast("int").alias("kept"),
                     F.lit(None).cast("boolean").alias("helped")).cast(state)

    def step(acc: Column, v: Column) -> Column:
        done = acc["kept"].isNotNull() & (acc["best"]["placed"] >= MIN_PLACED)
        passed = v["uses_dpi"] & ~F.coalesce(acc["helped"], F.lit(True))
        tried = ~done & ~passed
        wins = tried & recovered_more(v["s"], acc["best"])
        helped = F.when(tried & v["uses_dpi"], v["s"]["count"] > F.col("__o.count") * HELPED_BY_DPI).otherwise(acc["helped"])
        return F.struct(F.when(wins, v["s"]).otherwise(acc["best"]).alias("best"),
                        F.when(wins, v["index"]).otherwise(acc["kept"]).alias("kept"), helped.alias("helped")).cast(state)

    out = base.join(listed, list(keys)).withColumn("__r", F.aggregate("__v", start, step))
    return out.select(*keys, F.col("__r.kept").alias("kept"), F.col("__r.best.*"))


def megapixels(width: Column, height: Column, dpi: int) -> Column:
    """A-31: rasterised size of a page given in points; an oversized one is read at A4 area."""
    area = width * height
    shrink = F.when(area > MAX_PAGE_POINTS, F.lit(float(A4_POINTS)) / area).otherwise(1.0)
    return area * (dpi / 72) * (dpi / 72) * shrink / 1e6


def estimate_seconds(pages: DataFrame, keys: Sequence[str], dpi: int = DEFAULT_DPI) -> DataFrame:
    """A-31: run time of one pass over each document."""
    return pages.groupBy(*keys).agg((F.sum(megapixels(F.col("width"), F.col("height"), dpi)) * SECONDS_PER_MEGAPIXEL)
                                    .alias("seconds"))


def estimate_retries(pages: DataFrame, keys: Sequence[str], rank: Sequence[Column], k: int) -> DataFrame:
    """A-31: best and worst case of re-reading the ``k`` worst flagged pages (``poor_recall`` leads with resolution)."""
    top = top_n_per_key(pages, keys, rank, k, "__r")
    rate = SECONDS_PER_MEGAPIXEL * SINGLE_PAGE_OVERHEAD
    cheap = megapixels(F.col("width"), F.col("height"), DEFAULT_DPI) * rate
    dear = megapixels(F.col("width"), F.col("height"), RETRY_DPI) * rate
    return top.groupBy(*keys).agg(F.sum(F.when(F.col("poor_recall"), dear).otherwise(cheap)).alias("low"),
                                  F.sum(F.when(F.col("poor_recall"), dear + 2 * cheap).otherwise(2 * cheap)).alias("high"))


def printed_total(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-40: printed noteheads of a document, NULL when no page says."""
    return pages.groupBy(*keys).agg(F.sum(F.nullif("printed", F.lit(0))).alias("printed_total"))


# --- funnel ----------------------------------------------------------------------------------------

def funnel(heads: DataFrame, exported: DataFrame | Column, playable: DataFrame | Column, printed: DataFrame | Column, keys: Sequence[str]) -> DataFrame:
    """A-19: printed, detected, placed, exported and playable notes per page.

    Rows of all stages are counted in one union and one combined aggregate instead of a chain of
    outer joins. ``printed`` has a row per page; a scan's is NULL and stays so. A stage that can be told by the heads
    is a condition on them (``printed`` an aggregate of a page's); if all are, heads are read once.
    """
    one = F.lit(1).cast("bigint")
    given = {"exported": exported, "playable": playable}
    here = {n: F.coalesce(c, F.lit(False)).cast("bigint") for n, c in given.items() if isinstance(c, Column)}
    stages = ("printed", "detected", "placed", "exported", "playable")
    if len(here) == 2 and isinstance(printed, Column):
        counts = {"printed": printed.cast("bigint"), "detected": F.sum(one), "placed": F.sum(F.col("onset").isNotNull().cast("bigint")), **{n: F.sum(c) for n, c in here.items()}}
        return heads.groupBy(*keys).agg(*[counts[n].alias(n) for n in stages])

    def stage(df: DataFrame, **told: Column) -> DataFrame:
        cols = {c: F.lit(0).cast("bigint") for c in stages[1:]}
        cols["printed"] = F.lit(None).cast("bigint")
        cols.update(told)
        return df.select(*keys, *[c.alias(n) for n, c in cols.items()])

    if isinstance(printed, Column):
        printed = heads.groupBy(*keys).agg(printed.alias("printed"))
    rows = stage(heads, detected=one, placed=F.col("onset").isNotNull().cast("bigint"), **here).unionByName(stage(printed, printed=F.col("printed").cast("bigint")))
    for n, df in given.items():
        if n not in here:
            rows = rows.unionByName(stage(df, **{n: one}))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in stages])


def off_modal(measures: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A-20: bars off the most frequent length; of equally frequent ones the first seen counts."""
    counts = measures.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("n"), F.min("measure_index").alias("seen"))
    return counts.groupBy(*keys).agg(
        F.max_by("length", F.struct("n", -F.col("seen"))).alias("modal_length"),
        (F.sum("n") - F.max("n")).alias("off_modal"))


def funnel_totals(f: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A-21: sums, placed share, and recall against the printed count."""
    stages = ("printed", "detected", "placed", "exported", "playable")
    totals = f.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in stages])
    return (totals.withColumn("placed_share", F.try_divide(F.col("placed").cast("double"), F.col("detected")))
            .withColumn("recall", F.when(F.col("detected") > 0,
                                         F.try_divide(F.col("detected").cast("double"), F.col("printed")))))
