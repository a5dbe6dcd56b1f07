"""F-13: drawing and reading settings in one comparable struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWING = ("style", "octave", "notation", "font_size", "color")
READING = ("dpi", "auto_retry")


def _short_number(value: Column) -> Column:
    """A size as text: at most six significant digits, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.5f", value.cast("double")), r"0+$", ""), r"\.$", "")


def normal_settings(style: Column, octave: Column, notation: Column, font_size: Column, color: Column,
                    dpi: Column, auto_retry: Column) -> Column:
    """Missing and empty values get their defaults, so equal settings compare equal."""
    def text(col: Column, default: str) -> Column:
        return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))

    size = F.coalesce(F.nullif(font_size.cast("double"), F.lit(0.0)), F.lit(6.5))
    return F.struct(
        text(style, "unicode").alias("style"), F.coalesce(octave, F.lit(False)).alias("octave"),
        text(notation, "letters").alias("notation"), _short_number(size).alias("font_size"),
        F.lower(text(color, "#000000")).alias("color"), F.nullif(dpi.cast("int"), F.lit(0)).alias("dpi"),
        F.coalesce(auto_retry, F.lit(True)).alias("auto_retry"))


def settings_equal(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & a[f].eqNullSafe(b[f])
    return out
