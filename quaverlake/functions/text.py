"""Titles, settings and other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_title(value: Column) -> Column:
    """F-09: control characters that aren't white space go, then runs of white space become one space; NULL when nothing is left.

    The white space class is the Unicode one, with the four separator controls that also count.
    """
    printable = F.regexp_replace(value, r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]", "")
    return F.nullif(F.trim(F.regexp_replace(printable, r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " ")), F.lit(""))


def file_stem(name: Column) -> Column:
    """The file name without folders and its last extension; a leading dot starts no extension, a last one ends none."""
    base = F.regexp_extract(name, r"([^/]*)(?:/+\.?)*\z", 1)
    return F.regexp_replace(base, r"(?s)\A(.+)\.[^.]+\z", "$1")


def sheet_title(title: Column, name: Column) -> Column:
    """F-09: own title, else the file stem of the name."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(file_stem(name), F.lit("")), F.nullif(name, F.lit("")))


def contains_text(col: Column, q: str) -> Column:
    """P-11: case-insensitive containment; an empty search matches everything."""
    if not q:
        return F.lit(True)
    return F.contains(F.lower(col), F.lit(q.strip().lower()))


def ending_numbers(text: Column, longest: int) -> Column:
    """F-14: "1,3-4" as sorted distinct numbers; a range reaches at most ``longest`` past its start."""
    def one(piece: Column) -> Column:
        start = F.regexp_extract(piece, r"^(\d+)", 1).try_cast("bigint")
        end = F.regexp_extract(piece, r"^\d+-(\d+)$", 1)
        last = F.when(end == "", start).otherwise(F.least(end.try_cast("bigint"), start + longest))
        return F.when(piece.rlike(r"^\d+(-\d+)?$") & (last >= start), F.sequence(start, last)).otherwise(
            F.array().cast("array<bigint>"))

    pieces = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")), ",")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(pieces, one))))
