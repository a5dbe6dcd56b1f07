"""S-06: recognition books, zip archives of one XML sheet per page, as typed element tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.operators.geometry import confident, dedup_positions, weakest_inside
from quaverlake.operators.segments import islands, previous, settle
from quaverlake.session import cut_lineage

_BOX = "bounds struct<_x: double, _y: double, _w: double, _h: double>"
#: Elements of a sheet and what is read of them.
ELEMENTS = {
    "head": f"_id string, _staff int, _shape string, _pitch double, `_ctx-grade` double, _grade double, {_BOX}",
    "clef": f"_staff int, _kind string, {_BOX}",
    "key": f"_staff int, _fifths int, _grade double, {_BOX}",
    "key-alter": f"_staff int, _shape string, _grade double, {_BOX}",
    "alter": "_id string, _shape string",
    "time-pair": f"_staff int, `_time-rational` string, _grade double, {_BOX}",
    "time-number": f"_staff int, _grade double, {_BOX}",
    "staff": "_id int, lines struct<line: array<struct<point: array<struct<_y: double>>>>>",
    "slur": "_id string, _tie string",
    "relation": "_source string, _target string",
    "picture": "_width int, _height int",
}


def _unzip() -> Callable[[Iterator], Iterator]:
    """A function of its own, so that executors need no package of ours to run it."""

    def pages(batches: Iterator) -> Iterator:
        import io
        import re
        import zipfile

        import pyarrow as pa

        def batch_of(rows):
            ids, numbers, texts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "page", "xml"])

        rows, held = [], 0
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1)):
                if not content.is_valid:
                    continue
                doc_id = doc_id.as_py()
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    for name in book.namelist():
                        page = re.fullmatch(r"sheet#(\d+)/sheet#\1\.xml", name)
                        if page:
                            rows.append((doc_id, int(page.group(1)), book.read(name).decode("utf-8")))
                            held += len(rows[-1][2])
                        if held >= 1_000_000:  # characters; small pages go on together, a large one by itself
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return pages


def book_pages(books: DataFrame) -> DataFrame:
    """S-06: one row per page of the books (``doc_id``, ``content``): (doc_id, page, xml). Pages that a book left out give none.

    Python only opens archives; about a million characters of pages are handed on at once, and all reading of XML is the JVM's.
    """
    return books.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(_unzip(), "doc_id string, page int, xml string")


def read_book_pages(spark: SparkSession, path: str) -> DataFrame:
    return book_pages(spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content"))


def _found(tag: str) -> Column:
    """The XML of the elements of one kind, in their order on the page."""
    bare = F.regexp_replace("xml", r"(?s)<!--.*?-->", "")
    return F.regexp_extract_all(bare, F.lit(rf'(?s)<{tag}(?=[\s/>])(?:[^>"/]++|"[^"]*+"|/(?!>))*+(?:/>|>.*?</{tag}\s*>)'), F.lit(0))


def elements(pages: DataFrame, tag: str) -> DataFrame:
    """The elements of one kind, at any depth: doc_id, page, seq (their order on the page), xml and the parsed ``e``. Elements of a kind don't nest.

    They are parsed inside the array that is exploded: a filter on ``e`` then reads the value and doesn't parse again.
    """
    both = F.transform(_found(tag), lambda x: F.struct(x.alias("xml"), F.from_xml(x, ELEMENTS[tag]).alias("e")))
    return pages.select("doc_id", "page", F.posexplode(both).alias("seq", "el")).select("doc_id", "page", F.col("seq").cast("bigint").alias("seq"), "el.xml", "el.e")


def _boxed(pages: DataFrame, tag: str) -> DataFrame:
    e = elements(pages, tag).filter(F.col("e.bounds").isNotNull())
    return e.select("doc_id", "page", "seq", F.col("e._staff").alias("staff"), *[F.col(f"e.bounds._{c}").alias(c) for c in "xywh"], "e")


def _on_staves(pages: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """Boxed elements of several kinds that name a staff, from one reading of the pages: doc_id, page, tag, seq, staff, x, w, grade, and
    ``value``, the attribute that ``attributes`` gives for each kind, as text. Written down, since all that follows reads it again."""
    def of(tag: str, attribute: str) -> Column:
        def row(e: Column, i: Column) -> Column:
            return F.struct(F.lit(tag).alias("tag"), i.cast("bigint").alias("seq"), e["_staff"].alias("staff"), e["bounds"]["_x"].alias("x"), e["bounds"]["_w"].alias("w"),
                            e["_grade"].alias("grade"), e[attribute].cast("string").alias("value"), e["bounds"].isNotNull().alias("boxed"))
        return F.transform(F.transform(_found(tag), lambda x: F.from_xml(x, ELEMENTS[tag])), row)

    rows = F.concat(*[of(tag, attribute) for tag, attribute in attributes.items()])
    return cut_lineage(pages.select("doc_id", "page", F.inline(rows)).filter("boxed and staff is not null").drop("boxed"))


def heads(pages: DataFrame) -> DataFrame:
    """Detected heads with a box, one per rounded position; a fractional pitch takes the nearest step."""
    h = _boxed(pages, "head").select(
        "doc_id", "page", "seq", "staff", F.col("e._id").alias("head_id"), F.col("e._shape").alias("shape"), F.rint("e._pitch").cast("int").alias("pitch"),
        F.coalesce(F.col("e.`_ctx-grade`"), F.col("e._grade"), F.lit(0.0)).alias("confidence"), "x", "y", "w", "h")
    kept = dedup_positions(h, ["doc_id", "page", "staff"], "seq")
    return kept.withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)


def staff_lines(pages: DataFrame) -> DataFrame:
    """The line positions of staves with five lines, sorted."""
    ys = F.transform("e.lines.line", lambda line: line["point"][0]["_y"])
    return elements(pages, "staff").select("doc_id", "page", F.col("e._id").alias("staff"), F.array_sort(ys).alias("line_ys")).filter(F.size("line_ys") == 5)


def clefs(pages: DataFrame) -> DataFrame:
    """Clefs by the letter of their sign, other kinds by their own name."""
    kind = F.col("e._kind")
    return _boxed(pages, "clef").select("doc_id", "page", "staff", "x", "seq", F.when(kind == "TREBLE", "G").when(kind == "BASS", "F").otherwise(kind).alias("value")).filter(
        "value is not null and staff is not null")


def keys(pages: DataFrame, chunk_width: float | None = None) -> DataFrame:
    """Key events of enough confidence (P-16); staves without one get theirs from groups of key glyphs. ``chunk_width`` cuts long staves."""
    line = ["doc_id", "page", "staff"]
    read = confident(_on_staves(pages, {"key": "_fifths", "key-alter": "_shape"}))
    own = read.filter("tag = 'key' and value is not null").select(*line, "x", "seq", F.col("value").cast("int").alias("value"))
    glyph = read.filter("tag = 'key-alter'").select(*line, "x", F.coalesce("w", F.lit(10.0)).alias("w"), "seq", F.col("value").alias("shape")).join(own.select(*line).distinct(), line, "left_anti")
    chunk: Column | None = None if chunk_width is None else F.floor(F.col("x") / chunk_width).cast("bigint")
    glyph = settle(previous(glyph, line, ["x", "seq"], {"__px": "x", "__pw": "w"}, chunk), chunk)
    fresh = F.col("__px").isNull() | (F.col("x") - F.col("__px") > 3 * F.greatest("w", "__pw"))
    grouped = islands(glyph, line, ["x", "seq"], fresh, "__g", chunk).groupBy(*line, "__g").agg(
        F.min("x").alias("x"), F.min("seq").alias("seq"), F.sum(F.when(F.col("shape") == "SHARP", 1).when(F.col("shape") == "FLAT", -1).otherwise(0)).cast("int").alias("value"))
    return own.unionByName(grouped.select(*line, "x", "seq", "value"))


def meters(pages: DataFrame) -> DataFrame:
    """Recognised meters with the grade of their weakest digit (J-17)."""
    line = ["doc_id", "page", "staff"]
    read = _on_staves(pages, {"time-pair": "_time-rational", "time-number": "_grade"})
    parts = F.split("value", "/")
    num, den = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    pairs = read.filter((F.col("tag") == "time-pair") & (den > 0) & num.isNotNull()).select(
        *line, F.col("seq").alias("pair_id"), "x", F.coalesce("w", F.lit(0.0)).alias("w"), "grade", (num * 4 / den).alias("beats"))
    digits = read.filter("tag = 'time-number' and grade is not null").select(*line, F.col("x").alias("dx"), F.col("grade").alias("digit_grade"))
    return weakest_inside(pairs, digits, line)


def relations(pages: DataFrame) -> DataFrame:
    """Relation edges: source, target, kind (the element inside) and its side."""
    last = "/relation/*[last()]"
    # One reading of the element for both: a name holds no space.
    told = F.split(F.xpath_string("xml", F.lit(f"concat(name({last}), ' ', {last}/@side)")), " ", 2)
    return elements(pages, "relation").select("doc_id", "page", "seq", F.col("e._source").alias("source"), F.col("e._target").alias("target"),
                                              F.nullif(told[0], F.lit("")).alias("kind"), F.nullif(told[1], F.lit("")).alias("side"))
