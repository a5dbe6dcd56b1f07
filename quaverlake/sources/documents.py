"""JSON documents as tables: timelines, labels, reader edits, job log, notifications, usage reports.

Every reader has a form that takes a column of text, so documents may come from files, a table or a
stream alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOX = "array<double>"
TIMELINE = f"""struct<version: int, tempo_bpm_default: double, total_beats: double,
  tempo_map: array<struct<start_beat: double, bpm: double, beat_unit_quarters: double>>,
  measures: array<struct<index: int, printed_index: int, label: string, page: int, system: int, start_beat: double,
    length_beats: double, bbox_pt: {_BOX}, distinct_midis: array<int>, warnings: array<string>>>,
  notes: array<struct<source_id: string, printed_id: string, measure_index: int, part: int, staff: int, voice: string,
    midi: int, start_beat: double, duration_beats: double, key_duration_beats: double, is_grace: boolean,
    tie_start: boolean, tie_stop: boolean, bbox_pt: {_BOX}, pitch_source: string, confidence: double>>,
  audio_notes: array<struct<source_id: string, segment_ids: array<string>, midi: int, role: int, part: int,
    start_beat: double, duration_beats: double, velocity: double>>,
  events: array<struct<kind: string, part: int, staff: int, start_beat: double, value: string>>,
  stats: map<string, bigint>, warnings: array<string>>"""
#: The child tables of a timeline document.
TIMELINE_TABLES = ("measures", "notes", "audio_notes", "events", "tempo_map")
NO_TIMELINE = "No playback timeline was produced, so practice mode is unavailable"

LABELS = """struct<version: int, color: string, notation: string, items: array<string>, unnamed: array<string>>"""
LABEL_ITEM = "struct<id: string, group: string, page: double, x: double, y: double, size: double, text: string, notes: array<string>>"
UNNAMED = "struct<page: double, x: double, y: double, w: double>"
NOTATIONS = ("numbers", "solfege")

EDITS = "struct<labels: map<string, string>, texts: array<string>, strokes: array<string>, corrections: map<string, string>>"
LABEL_EDIT = "struct<dx: double, dy: double, text: string, hidden: boolean, color: string>"
TEXT_NOTE = "struct<id: string, page: double, x: double, y: double, text: string, size: double, color: string>"
STROKE = "struct<id: string, page: double, tool: string, color: string, width: double, points: array<double>>"
CORRECTION = "struct<midi: double, hand: string, offset: double, duration: double>"
COLOR = "(?i)^#[0-9a-f]{6}$"

REPORT = "struct<session_id: string, job_id: string, surface: string, platform: string, seconds: int, playing_seconds: int, events: map<string, int>>"
REPORT_FIELDS = ("session_id", "job_id", "surface", "platform", "seconds", "playing_seconds", "events")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and text. Whole files are read, however long."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


# --- S-03 timelines ------------------------------------------------------------------------------

def parse_timelines(docs: DataFrame, text: str = "text") -> DataFrame:
    """S-03: ``doc`` (the parsed document), ``readable`` and ``missing``: no text at all means there is no
    timeline; text that is no document gives a NULL quality later."""
    doc = F.from_json(F.col(text), TIMELINE, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(F.col(text)).isNotNull() & F.startswith(F.ltrim(text), F.lit("{"))
    return (docs.withColumn("missing", F.col(text).isNull()).withColumn("readable", F.coalesce(ok, F.lit(False)))
            .withColumn("doc", F.when(F.col("readable"), doc)))


def timeline_table(parsed: DataFrame, name: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """S-03: one child table of parsed timelines."""
    if name not in TIMELINE_TABLES:
        raise ValueError(f"no timeline table {name}")
    return parsed.filter("readable").select(*keys, F.posexplode(F.col(f"doc.{name}")).alias("pos", "r")).select(*keys, "pos", "r.*")


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    return parse_timelines(_texts(spark, path))


def quality_input(parsed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What :func:`quality.timeline_quality` reads; unreadable documents are left out (their quality is NULL)."""
    return parsed.filter(F.col("readable") | F.col("missing")).select(
        *keys, F.transform("doc.measures", lambda m: F.struct(m["warnings"].alias("warnings"))).alias("measures"),
        F.coalesce("doc.stats", F.create_map().cast("map<string,bigint>")).alias("stats"), F.col("doc.warnings").alias("warnings"), "missing")


# --- S-04 labels ---------------------------------------------------------------------------------

def _finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col)


def parse_labels(docs: DataFrame, text: str = "text") -> DataFrame:
    """S-04: ``items`` and ``unnamed`` of label documents. Malformed rows go one by one, an unknown
    notation means letters, an item without a group is its own."""
    d = docs.withColumn("__d", F.from_json(F.col(text), LABELS))

    def item(raw: Column) -> Column:
        i = F.from_json(raw, LABEL_ITEM)
        return F.struct(i["id"].alias("id"), F.coalesce(i["group"], i["id"]).alias("group"), i["page"].cast("int").alias("page"), i["x"].alias("x"),
                        i["y"].alias("y"), i["size"].alias("size"), i["text"].alias("text"),
                        F.coalesce(i["notes"], F.array().cast("array<string>")).alias("notes"))

    def good(i: Column) -> Column:
        return i["id"].isNotNull() & i["text"].isNotNull() & _finite(i["page"]) & _finite(i["x"]) & _finite(i["y"]) & _finite(i["size"])

    items = F.filter(F.transform(F.coalesce("__d.items", F.array().cast("array<string>")), item), good)
    heads = F.filter(F.transform(F.coalesce("__d.unnamed", F.array().cast("array<string>")), lambda r: F.from_json(r, UNNAMED)),
                     lambda u: _finite(u["x"]) & _finite(u["y"]) & _finite(u["w"]) & _finite(u["page"]) & (u["page"] % 1 == 0))
    notation = F.when(F.col("__d.notation").isin(*NOTATIONS), F.col("__d.notation")).otherwise("letters")
    return (d.withColumn("items", items).withColumn("unnamed", heads).withColumn("notation", notation)
            .withColumn("color", F.coalesce("__d.color", F.lit("#000000"))).drop("__d"))


def label_items(parsed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return parsed.select(*keys, "notation", F.inline("items"))


def unnamed_notes(parsed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return parsed.select(*keys, F.inline("unnamed"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(_texts(spark, path))


# --- S-05 reader edits ---------------------------------------------------------------------------

def parse_edits(docs: DataFrame, text_limit: int, text: str = "text") -> DataFrame:
    """S-05: ``labels``, ``texts``, ``strokes``, ``corrections`` of edit documents, each malformed entry dropped alone."""
    d = docs.withColumn("__d", F.from_json(F.col(text), EDITS))

    def color(c: Column) -> Column:
        return F.coalesce(c.rlike(COLOR), F.lit(False))

    def label(_, raw: Column) -> Column:
        e = F.from_json(raw, LABEL_EDIT)
        return F.struct(e["dx"].alias("dx"), e["dy"].alias("dy"), F.substring(e["text"], 1, text_limit).alias("text"),
                        F.when(e["hidden"], True).alias("hidden"), F.when(color(e["color"]), e["color"]).alias("color"))

    def any_set(_, e: Column) -> Column:
        return F.coalesce(e["dx"].cast("string"), e["dy"].cast("string"), e["text"], e["hidden"].cast("string"), e["color"]).isNotNull()

    labels = F.map_filter(F.transform_values("__d.labels", label), any_set)
    texts = F.filter(F.transform("__d.texts", lambda r: F.from_json(r, TEXT_NOTE)),
                     lambda t: t["id"].isNotNull() & t["text"].isNotNull() & _finite(t["page"]) & _finite(t["x"]) & _finite(t["y"]) & _finite(t["size"]) & color(t["color"]))
    strokes = F.filter(F.transform("__d.strokes", lambda r: F.from_json(r, STROKE)),
                       lambda s: s["id"].isNotNull() & _finite(s["page"]) & F.coalesce(s["tool"].isin("pen", "highlighter"), F.lit(False)) & color(s["color"])
                       & _finite(s["width"]) & (F.coalesce(F.size(s["points"]), F.lit(0)) >= 2) & F.forall(s["points"], _finite))
    fixes = F.map_filter(F.transform_values("__d.corrections", lambda _, r: F.from_json(r, CORRECTION)),
                         lambda _, c: F.coalesce(c["midi"].between(21, 108) & (c["midi"] % 1 == 0), F.lit(False))
                         & F.coalesce(c["hand"], F.lit("left")).isin("left", "right") & F.coalesce(c["offset"] >= 0, F.lit(False))
                         & F.coalesce((c["duration"] > 0) & (c["duration"] <= 128), F.lit(False)))
    return d.withColumns({"labels": labels, "texts": texts, "strokes": strokes, "corrections": fixes}).drop("__d")


def read_edits(spark: SparkSession, path: str, text_limit: int) -> DataFrame:
    return parse_edits(_texts(spark, path), text_limit)


# --- S-07 job log --------------------------------------------------------------------------------

JOB_LOG = "struct<event: string, job_id: string, user_id: string, music_sheet_id: string, sheet_name: string>"


def parse_job_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """S-07: event and identity of log lines; the free fields stay in ``fields`` (VARIANT). Lines that
    are no JSON objects are dropped."""
    parsed = lines.withColumn("__j", F.from_json(F.col(text), JOB_LOG)).withColumn("fields", F.try_parse_json(F.col(text)))
    keep = F.col("fields").isNotNull() & F.startswith(F.ltrim(text), F.lit("{"))
    return parsed.filter(keep).select("*", "__j.*").drop("__j")


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_job_log(spark.read.text(path)).drop("value")


# --- S-08 notifications ----------------------------------------------------------------------------

NOTIFICATION = ("struct<job_id: string, Records: array<struct<s3: struct<bucket: struct<name: string>, "
                "object: struct<key: string, versionId: string>>>>>")


def parse_notifications(df: DataFrame, bucket: str, text: str = "value") -> DataFrame:
    """S-08: (job_id, version) of queue messages: a bare job id, or every created ``jobs/*/*/input`` of the bucket."""
    body = F.from_json(F.col(text), NOTIFICATION)
    d = df.withColumn("__b", body)
    bare = d.filter(F.col("__b.job_id").isNotNull()).select(*df.columns, F.col("__b.job_id").alias("job_id"), F.lit(None).cast("string").alias("version"))
    rec = d.filter(F.col("__b.job_id").isNull()).select(*df.columns, F.explode("__b.Records").alias("r"))
    parts = F.split(F.try_url_decode(F.col("r.s3.object.key")), "/", -1)
    rec = rec.withColumn("__p", parts).filter((F.size("__p") == 4) & (F.get("__p", F.lit(0)) == "jobs") & (F.get("__p", F.lit(3)) == "input")
                                              & (F.col("r.s3.bucket.name") == bucket))
    return bare.unionByName(rec.select(*df.columns, F.get("__p", F.lit(2)).alias("job_id"), F.col("r.s3.object.versionId").alias("version")))


# --- S-09 usage reports ----------------------------------------------------------------------------

def parse_usage_reports(lines: DataFrame, text: str = "value") -> DataFrame:
    """S-09: usage reports from JSON text, batch or stream; ``extra`` names the fields a report may not have."""
    raw = F.from_json(F.col(text), "map<string,string>")
    known = F.array(*[F.lit(f) for f in REPORT_FIELDS])
    extra = F.coalesce(F.array_except(F.map_keys(raw), known), F.array().cast("array<string>"))
    return lines.withColumn("extra", extra).withColumn("__r", F.from_json(F.col(text), REPORT)).select("*", "__r.*").drop("__r")


def read_usage_reports(spark: SparkSession, path: str) -> DataFrame:
    """S-09: a stream of report files, one JSON report per line."""
    return parse_usage_reports(spark.readStream.text(path))


# --- S-10 sink ---------------------------------------------------------------------------------------

def write_documents(df: DataFrame, path: str, attempt: str) -> None:
    """S-10: documents as JSON under job and attempt. An attempt has its own folder and is replaced
    whole when it runs again, so no attempt touches another's files."""
    (df.withColumn("attempt", F.lit(attempt)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("job_id", "attempt").json(path))
