"""F-19: printed marks read from text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.operators.bands import band_join

# Note glyphs of metronome marks with their length in quarters; octave labels.
METRONOMES = {chr(code): quarters for code, quarters in (
    (0xECA2, 4.0), (0xECA3, 2.0), (0xECA4, 2.0), (0xECA5, 1.0), (0xECA6, 1.0), (0xECA7, 0.5), (0xECA8, 0.5),
    (0xECA9, 0.25), (0xECAA, 0.25), (0x2669, 1.0), (0x266A, 0.5))}
METRONOME = "^.\\s*([\uECB7.·]*)\\s*=\\s*(\\d+(?:\\.\\d+)?)\\b"
OCTAVE_AMOUNT = {"8": 1, "8va": 1, "8vb": 1, "15": 2, "15ma": 2, "22": 3}
OCTAVE_DIRECTION = {"8va": 1, "15ma": 1, "8vb": -1}
OCTAVE_LABEL = r"^(8(?:va|vb)?|15(?:ma)?|22)([-–—]*)$"


def _map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def metronome(text: Column) -> Column:
    """"unit dots = number" as struct(bpm in quarters, beat_unit_quarters), NULL outside 10..600."""
    unit = F.try_element_at(_map(METRONOMES), F.substring(text, 1, 1))
    dots = F.length(F.regexp_extract(text, METRONOME, 1))
    number = F.regexp_extract(text, METRONOME, 2).try_cast("double")
    quarters = unit * (2 - F.pow(F.lit(0.5), dots))
    return F.when(text.rlike(METRONOME) & (number * quarters).between(10, 600),
                  F.struct((number * quarters).alias("bpm"), quarters.alias("beat_unit_quarters")))


def octave_label(text: Column) -> Column:
    """An octave label as struct(amount, direction (NULL unknown), dashes), NULL for other text."""
    label = F.lower(F.regexp_extract(F.trim(text), "(?i)" + OCTAVE_LABEL, 1))
    return F.when(F.trim(text).rlike("(?i)" + OCTAVE_LABEL), F.struct(
        F.try_element_at(_map(OCTAVE_AMOUNT), label).alias("amount"),
        F.try_element_at(_map(OCTAVE_DIRECTION), label).alias("direction"),
        F.length(F.regexp_extract(F.trim(text), "(?i)" + OCTAVE_LABEL, 2)).alias("dashes")))


def meter_beats(signs: Column) -> Column:
    """Beats of a meter given as an array of "3+2/8" texts, added up."""
    def one(sign: Column) -> Column:
        upper = F.split(F.split_part(sign, F.lit("/"), F.lit(1)), r"\+")
        lower = F.coalesce(F.split_part(sign, F.lit("/"), F.lit(2)).try_cast("int"), F.lit(4))
        total = F.aggregate(upper, F.lit(0.0), lambda a, b: a + F.coalesce(b.try_cast("double"), F.lit(0.0)))
        return total * 4 / F.greatest(F.lit(1), lower)
    return F.aggregate(F.transform(signs, one), F.lit(0.0), lambda a, b: a + b)


def metronome_marks(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metronome marks of a page from text spans (``span_id``, box, ``text``): the spans set close to
    the right of a note glyph are joined and read together. A span meets only spans within 5 points of
    its line."""
    mid, height = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    unit = F.try_element_at(_map(METRONOMES), F.substring(F.trim("text"), 1, 1))
    heads = spans.withColumn("mid", mid).filter(unit.isNotNull())
    near = spans.select(*keys, F.col("x0").alias("nx"), mid.alias("nmid"), height.alias("nh"), F.col("text").alias("ntext"),
                        F.col("span_id").alias("nid"))
    ok = (F.col("nx").between(F.col("x0") - 1, F.col("x1") + 65) & (F.col("nx") < F.col("x1") + 65)
          & (F.abs(F.col("nmid") - F.col("mid")) < 5) & (F.col("nh") <= (F.col("y1") - F.col("y0")) * 1.5))
    pairs = band_join(heads, near, keys, "mid", "nmid", 5.0, ok)
    joined = pairs.groupBy(*keys, "span_id", "x0", F.col("mid").alias("y")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nx", "nid", "ntext"))), lambda s: s["ntext"]), "").alias("joined"))
    return (joined.withColumn("m", metronome(F.ltrim("joined"))).filter(F.col("m").isNotNull())
            .select(*keys, F.col("span_id").alias("mark_id"), F.col("x0").alias("x"), "y", "m.*"))
