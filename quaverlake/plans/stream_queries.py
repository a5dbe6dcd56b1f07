"""Registered queries of document sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaverlake.functions.times import to_epoch
from quaverlake.operators import engagement as E
from quaverlake.operators import subscriptions as S
from quaverlake.plans.page_queries import heads
from quaverlake.plans.registry import query
from quaverlake.plans.sql_bindings import define, with_ctes
from quaverlake.sources import bindings as B
from quaverlake.sources import books, documents
from quaverlake.streaming import alarms as AL
from quaverlake.streaming import control as C
from quaverlake.streaming import stateful as SF
from quaverlake.streaming import usage as U
from quaverlake.streaming.sinks import run_available, stream_root


def table_stream(spark, d, name):
    """A table as a stream of one file."""
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def event_stream(spark, d):
    return table_stream(spark, d, "events")


# --- documents -------------------------------------------------------------------------------------

def _timeline_texts(spark, d):
    """Orders as timeline documents. Every seventh begins with a stray character and can't be read, every eleventh is missing."""
    n = B.score_notes(spark, d)
    note = F.struct(F.lpad(F.col("slot").cast("string"), 6, "0").alias("source_id"), F.col("measure").cast("int").alias("measure_index"),
                    F.col("midi").cast("int").alias("midi"), (F.col("slot") * 0.5).alias("start_beat"), F.col("duration").alias("duration_beats"))
    # One document holds one order: its lines are few by the meaning of a document.
    per = n.groupBy("doc_id").agg(F.sort_array(F.collect_list(note)).alias("notes"), F.max("measure").alias("m"), F.count(F.lit(1)).alias("c"))
    bar = F.transform(F.sequence(F.lit(0), F.col("m").cast("int")), lambda i: F.struct(i.alias("index"), F.array(F.lit("odd")).alias("warnings")))
    doc = F.to_json(F.struct(F.lit(2).alias("version"), bar.alias("measures"), "notes",
                             F.create_map(F.lit("notes_matched"), F.col("c"), F.lit("notes_unmatched"), F.col("c") % 3).alias("stats")))
    text = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("<"), doc)).otherwise(doc)
    return per.select("doc_id", text.alias("text"))


@query("S03_read_timelines", with_ctes("notes") + """
    SELECT doc_id, slot AS pos, lpad(CAST(slot AS VARCHAR), 6, '0') AS source_id, CAST(measure AS INTEGER) AS measure_index, CAST(midi AS INTEGER) AS midi, CAST(slot * 0.5 AS DOUBLE) AS start_beat, duration AS duration_beats
    FROM notes WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0""")
def _(spark, d):
    parsed = documents.parse_timelines(_timeline_texts(spark, d))
    return documents.timeline_table(parsed, "notes").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "source_id", "measure_index", "midi", "start_beat", "duration_beats")


@query("S03_timeline_quality", with_ctes("notes") + """
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE max(measure) + 1 END AS n_measures, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE count(*) % 3 END AS notes_unmatched,
           doc_id % 11 = 0 AS missing FROM notes WHERE doc_id % 11 = 0 OR doc_id % 7 <> 0 GROUP BY 1""")
def _(spark, d):
    from quaverlake.operators.quality import timeline_quality
    q = timeline_quality(documents.quality_input(documents.parse_timelines(_timeline_texts(spark, d))))
    return q.select("doc_id", F.col("n_measures").cast("bigint").alias("n_measures"), "notes_unmatched", "missing")


@query("S04_read_labels", """
    SELECT doc_id, CASE WHEN lang = 'en' THEN 'numbers' ELSE 'letters' END AS notation, 'a' || doc_id AS id,
           CASE WHEN doc_id % 2 = 0 THEN 'g' ELSE 'a' || doc_id END AS "group", CAST(n_chars % 9 AS INTEGER) AS page, text
    FROM documents WHERE source NOT IN ('src1', 'src2')""")
def _(spark, d):
    doc = B.documents(spark, d)
    ident = F.concat(F.lit("a"), F.col("doc_id").cast("string"))
    # Labels of two sources lack a position or an id; an extra item is no object at all.
    item = F.struct(F.when(F.col("source") != "src1", ident).alias("id"), F.when(F.col("doc_id") % 2 == 0, "g").alias("group"), (F.col("n_chars") % 9).alias("page"),
                    F.when(F.col("source") != "src2", F.lit(1.5)).alias("x"), F.lit(2.0).alias("y"), F.lit(6.5).alias("size"), F.col("text"))
    notation = F.when(F.col("lang") == "en", "numbers").otherwise("runes")
    body = F.concat(F.lit('{"notation":"'), notation, F.lit('","items":['), F.to_json(item), F.lit(',"odd"]}'))
    parsed = documents.parse_labels(doc.select("doc_id", body.alias("text")))
    return documents.label_items(parsed).select("doc_id", "notation", "id", "group", "page", "text")


@query("S05_read_edits", """
    SELECT doc_id, 'n' || doc_id AS label_id, substr(text, 1, 40) AS text, CASE WHEN doc_id % 2 = 0 THEN '#00aaFF' END AS color,
           CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_corrections FROM documents""")
def _(spark, d):
    doc = B.documents(spark, d)
    name = F.concat(F.lit("n"), F.col("doc_id").cast("string"))
    edit = F.struct("text", F.when(F.col("doc_id") % 2 == 0, "#00aaFF").otherwise("red").alias("color"))
    fix = F.struct(F.when(F.col("doc_id") % 3 == 0, 60).otherwise(200).alias("midi"), F.lit("left").alias("hand"), F.lit(0.0).alias("offset"), F.lit(1.0).alias("duration"))
    body = F.to_json(F.struct(F.create_map(name, edit, F.lit("empty"), F.struct(F.lit(None).cast("string").alias("text"), F.lit("blue").alias("color"))).alias("labels"),
                              F.create_map(F.lit("p"), fix).alias("corrections")))
    parsed = documents.parse_edits(doc.select("doc_id", body.alias("text")), 40)
    n = F.size("corrections")
    return parsed.select("doc_id", n.alias("n_corrections"), F.explode("labels").alias("label_id", "e")).select("doc_id", "label_id", "e.text", "e.color", "n_corrections")


@query("S06_read_books", with_ctes("heads") + """
    SELECT doc_id, CAST(page AS INTEGER) AS page, head_id, CAST(pitch AS INTEGER) AS pitch, cx FROM heads
    QUALIFY row_number() OVER (PARTITION BY doc_id, page, staff, round_even(cx - w / 2, 1), cy ORDER BY seq) = 1""")
def _(spark, d):
    out = books.heads(_books(spark, d))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "page", "head_id", "pitch", "cx")


def _books(spark, d):
    """Heads as books: one archive a page, whose sheet also has a clef, key, meter or relation beside some of the heads, and staves."""
    seq, staff, pitch, cx = (F.col(c).cast("string") for c in ("seq", "staff", "pitch", "cx"))
    bounds = F.format_string('<bounds x="%s" y="%s" w="%s" h="4"/>', (F.col("cx") - F.col("w") / 2).cast("string"), F.col("cy").cast("string"), F.col("w").cast("string"))

    def tag(name, attrs, inner):
        text = [F.lit(f"<{name}")]
        for k, v in attrs.items():
            text += [F.lit(f' {k}="'), v if not isinstance(v, str) else F.lit(v), F.lit('"')]
        return F.concat(*text, F.lit(">"), inner, F.lit(f"</{name}>"))

    some = lambda n, k=0: F.col("seq") % n == k
    at = F.concat(F.lit('<bounds x="'), cx, F.lit('" y="0" w="10" h="4"/>'))
    sharp = F.when(F.col("pitch") % 2 == 0, "SHARP").otherwise("FLAT")
    parts = [tag("head", {"id": F.col("head_id"), "staff": staff, "pitch": pitch}, bounds),
             F.when(some(7), tag("clef", {"staff": staff, "kind": F.when(F.col("pitch") > 2, "TREBLE").when(F.col("pitch") > -2, "BASS").otherwise("ALTO")}, at)),
             F.when(some(5) & (F.col("staff") == 1), tag("key", {"staff": staff, "fifths": (F.col("pitch") % 7).cast("string"), "grade": F.when(F.col("pitch") > 3, "0.25").otherwise("0.75")}, at)),
             F.when(some(3), tag("key-alter", {"staff": staff, "shape": sharp, "grade": "0.5"}, at)),
             F.when(some(4), tag("time-pair", {"staff": staff, "time-rational": F.concat((F.col("pitch") + 8).cast("string"), F.lit("/8")), "grade": "0.5"}, at)),
             F.when(some(2), tag("time-number", {"staff": staff, "grade": ((F.col("pitch") + 7) / 16).cast("string")}, at)),
             F.when(some(3, 1), tag("relation", {"source": F.concat(F.lit("c&amp;"), seq), "target": F.col("head_id")}, F.when(F.col("pitch") > 0, '<slur-head side="RIGHT"/>').otherwise("<containment/>")))]
    lines = F.concat_ws("", *[F.concat(F.lit('<line><point x="0" y="'), (F.col("staff") * 100 + (k * 3) % 5 * 10).cast("string"), F.lit('"/><point x="9" y="1"/></line>')) for k in range(5)])
    h = heads(spark, d).withColumn("el", F.concat_ws("", *parts)).withColumn("st", tag("staff", {"id": staff}, F.concat(F.lit("<lines>"), lines, F.lit("</lines>"))))
    # One sheet is one page: its elements are few by the meaning of a page.
    sheets = h.groupBy("doc_id", "page").agg(F.array_join(F.array_distinct(F.collect_list("st")), "").alias("staves"),
                                             F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "el"))), lambda s: s["el"]), "").alias("inters"))
    xml = F.concat(F.lit('<sheet><!-- <head id="none"/> --><page>'), "staves", F.lit("</page><sig>"), "inters", F.lit("</sig></sheet>"))
    return books.book_pages(sheets.select("doc_id", "page", xml.alias("xml")).mapInArrow(_zipper(), "doc_id string, content binary"))


def _zipper():
    """One small archive per page, so the reader has books to open."""

    def zipped(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            out = []
            for page, xml in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("book.xml", "<book/>")
                    z.writestr(f"sheet#{page}/sheet#{page}.xml", xml)
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["doc_id", "content"])

    return zipped


def _of_book(df, *cols):
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "page", *cols)


@query("S06_book_clefs", with_ctes("heads") + """
    SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(staff AS INTEGER) AS staff, cx AS x, CASE WHEN pitch > 2 THEN 'G' WHEN pitch > -2 THEN 'F' ELSE 'ALTO' END AS value FROM heads WHERE seq % 7 = 0""")
def _(spark, d):
    return _of_book(books.clefs(_books(spark, d)), "staff", "x", "value")


@query("S06_book_keys", with_ctes("heads") + """
    , own AS (SELECT doc_id, page, staff, cx AS x, CAST(pitch % 7 AS INTEGER) AS value FROM heads WHERE seq % 5 = 0 AND staff = 1 AND pitch <= 3),
    g AS (SELECT *, cx - lag(cx) OVER (PARTITION BY doc_id, page, staff ORDER BY cx, seq) AS step FROM heads h WHERE seq % 3 = 0
          AND NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = h.doc_id AND o.page = h.page AND o.staff = h.staff)),
    r AS (SELECT *, count(*) FILTER (step IS NULL OR step > 30) OVER (PARTITION BY doc_id, page, staff ORDER BY cx, seq ROWS UNBOUNDED PRECEDING) AS n FROM g),
    k AS (SELECT * FROM own UNION ALL SELECT doc_id, page, staff, min(cx), CAST(sum(CASE WHEN pitch % 2 = 0 THEN 1 ELSE -1 END) AS INTEGER) FROM r GROUP BY doc_id, page, staff, n)
    SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(staff AS INTEGER) AS staff, x, value FROM k""".replace("\n    , own", ", own"))
def _(spark, d):
    return _of_book(books.keys(_books(spark, d), 64.0), "staff", "x", "value")


@query("S06_book_meters", with_ctes("heads") + """
    , m AS (SELECT doc_id, page, staff, seq, cx, (pitch + 8) * 4 / 8 AS beats, coalesce((SELECT min((b.pitch + 7) / 16) FROM heads b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.staff = a.staff AND b.seq % 2 = 0
        AND b.cx BETWEEN a.cx - 2 AND a.cx + 12), 0.5) AS grade FROM heads a WHERE seq % 4 = 0)
    SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(staff AS INTEGER) AS staff, cx AS x, CAST(beats AS DOUBLE) AS beats, CAST(grade AS DOUBLE) AS grade, grade < 0.4 AS low_confidence FROM m""".replace("\n    , m", ", m"))
def _(spark, d):
    return _of_book(books.meters(_books(spark, d)), "staff", "x", "beats", "grade", "low_confidence")


@query("S06_book_lines", with_ctes("heads") + """
    SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(staff AS INTEGER) AS staff, CAST(staff * 100 AS DOUBLE) AS top, CAST(staff * 100 + 40 AS DOUBLE) AS bottom FROM heads GROUP BY 1, 2, 3, 4, 5""")
def _(spark, d):
    return _of_book(books.staff_lines(_books(spark, d)), "staff", F.col("line_ys")[0].alias("top"), F.col("line_ys")[4].alias("bottom"))


@query("S06_book_relations", with_ctes("heads") + """
    SELECT doc_id, CAST(page AS INTEGER) AS page, 'c&' || seq AS source, head_id AS target, CASE WHEN pitch > 0 THEN 'slur-head' ELSE 'containment' END AS kind, CASE WHEN pitch > 0 THEN 'RIGHT' END AS side FROM heads WHERE seq % 3 = 1""")
def _(spark, d):
    return _of_book(books.relations(_books(spark, d)), "source", "target", "kind", "side")


def _log_lines(spark, d):
    e = B.table(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("job_id"), F.col("user_id").cast("string").alias("user_id"),
                              F.when(F.col("event_type") == "view", F.floor("value")).alias("desired")))
    return e.select("event_id", F.when(F.col("event_id") % 13 == 0, "START RequestId").otherwise(line).alias("value"))


@query("S07_job_log", """
    SELECT event_id, event_type AS event, CAST(event_id AS VARCHAR) AS job_id, CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS desired
    FROM events WHERE event_id % 13 <> 0""")
def _(spark, d):
    log = documents.parse_job_log(_log_lines(spark, d))
    return log.select("event_id", "event", "job_id", F.try_variant_get("fields", "$.desired", "bigint").alias("desired"))


@query("ST10_log_metric", """
    SELECT event_id, floor(value) AS metric FROM events WHERE event_id % 13 <> 0 AND event_type = 'view'""")
def _(spark, d):
    return AL.log_metric(_log_lines(spark, d), "$.desired").select("event_id", "metric")


@query("S08_notifications", """
    SELECT event_id, CAST(event_id AS VARCHAR) AS job_id, CASE WHEN event_type = 'error' THEN NULL ELSE 'v' || user_id END AS version
    FROM events WHERE event_type IN ('view', 'error')""")
def _(spark, d):
    e = B.table(spark, d, "events")
    ident = F.col("event_id").cast("string")
    bucket = F.when(F.col("event_type") == "click", "elsewhere").otherwise("files")
    end = F.when(F.col("event_type") == "signup", "output").otherwise("input")
    key = F.concat(F.lit("jobs/a%2Bb/"), ident, F.lit("/"), end, F.when(F.col("event_type") == "purchase", "/x").otherwise(""))
    record = F.struct(F.struct(F.struct(bucket.alias("name")).alias("bucket"), F.struct(key.alias("key"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("versionId")).alias("object")).alias("s3"))
    body = F.when(F.col("event_type") == "error", F.to_json(F.struct(ident.alias("job_id")))).otherwise(F.to_json(F.struct(F.array(record).alias("Records"))))
    return documents.parse_notifications(e.select("event_id", body.alias("value")), "files").select("event_id", "job_id", "version")


@query("S09_usage_reports", """
    SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, CAST(floor(value) AS INTEGER) AS seconds, CASE WHEN event_type = 'error' THEN 'volume' ELSE '' END AS extra FROM events""")
def _(spark, d):
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("job_id"), F.floor("value").alias("seconds"), F.when(F.col("event_type") == "error", 3).alias("volume")))
    lines = event_stream(spark, d).select("event_id", body.alias("value"))
    parsed = documents.parse_usage_reports(lines).select("event_id", "job_id", "seconds", F.array_join("extra", ",").alias("extra"))
    return run_available(parsed)


@query("S10_write_documents", with_ctes("job_heads") + "SELECT job_id, status AS text, 'a2' AS attempt FROM job_heads")
def _(spark, d):
    # Jobs share one folder per status here: the partition columns are what is tested, not their number.
    out = stream_root(spark)
    docs = B.job_heads(spark, d).select(F.col("status").alias("job_id"), F.col("job_id").alias("doc"), F.col("status").alias("text"))
    for attempt in ("a1", "a2"):
        documents.write_documents(docs, out, attempt)
    back = spark.read.schema("doc string, text string, job_id string, attempt string").json(out)
    return back.filter(F.col("attempt") == "a2").select(F.col("doc").alias("job_id"), "text", "attempt")


# --- sessions and meter ------------------------------------------------------------------------------

_SESSION = """SELECT user_id, session_id, job_id, surface, platform, started_at, last_at, seconds, playing_seconds, reports, admin FROM sessions"""
_SESSION_COLUMNS = ("user_id", "session_id", "job_id", "surface", "platform", "started_at", "last_at", "seconds", "playing_seconds", "reports", "admin")


def _stream_reports(spark, d):
    return E.single_control(B.reports_of(event_stream(spark, d)))


@query("ST01_usage_sessions", with_ctes("sessions") + _SESSION)
def _(spark, d):
    table = run_available(U.usage_sessions(_stream_reports(spark, d)), "update", ("user_id", "session_id"))
    return U.live_sessions(table, B.EVENTS_NOW).select(*_SESSION_COLUMNS)


@query("ST01_session_state", with_ctes("sessions") + _SESSION)
def _(spark, d):
    return SF.session_table(_stream_reports(spark, d)).select(*_SESSION_COLUMNS)


define("meter", """
    SELECT user_id AS session_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at_ms, event_id AS seq, event_type,
           CASE WHEN event_type IN ('view', 'error', 'purchase') THEN 'tick' WHEN event_type = 'click' THEN 'count' ELSE 'input' END AS kind FROM events""")


def meter(spark, d):
    """Events on a clock a thousand times faster, so that ticks, idle times and bursts occur."""
    return meter_of(B.table(spark, d, "events"))


def meter_of(events):
    kind = F.when(F.col("event_type").isin("view", "error", "purchase"), "tick").when(F.col("event_type") == "click", "count").otherwise("input")
    return events.select(
        F.col("user_id").alias("session_id"), to_epoch(F.col("ts")).alias("at_ms"), F.col("event_id").alias("seq"), kind.alias("kind"),
        (F.col("event_type") != "error").alias("visible"), (F.col("event_type") == "purchase").alias("playing"), "event_type")


_ACTIVITY = with_ctes("meter") + """
    , w AS (SELECT *, min(at_ms) OVER (PARTITION BY session_id) AS op, last_value(CASE WHEN kind = 'tick' THEN at_ms END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tk,
                   last_value(CASE WHEN kind <> 'tick' THEN at_ms END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inp FROM meter WINDOW o AS (PARTITION BY session_id ORDER BY at_ms, seq)),
    e AS (SELECT *, least(5000, greatest(0, at_ms - coalesce(tk, op))) AS el FROM w WHERE kind = 'tick')
    SELECT session_id, seq, CAST(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN el ELSE least(el, greatest(0, coalesce(inp, op) + 300000 - (at_ms - el))) END AS BIGINT) AS active_ms,
           CAST(CASE event_type WHEN 'purchase' THEN el ELSE 0 END AS BIGINT) AS playing_ms FROM e""".replace("\n    , w", ", w")


@query("ST02_activity_stream", _ACTIVITY + " WHERE at_ms <= (SELECT max(at_ms) - 60000 FROM meter)")
def _(spark, d):
    events = meter_of(event_stream(spark, d)).withColumn("session_id", F.col("session_id").cast("string"))
    return SF.run_stateful(SF.activity_stream(events, "60 seconds")).select(F.col("session_id").cast("bigint").alias("session_id"), "seq", "active_ms", "playing_ms")


@query("ST02_activity_seconds", _ACTIVITY)
def _(spark, d):
    return U.activity(meter(spark, d), chunk_ms=86_400 * 4).select("session_id", "seq", "active_ms", "playing_ms")


@query("ST03_debounce", with_ctes("meter").replace("WITH", "WITH RECURSIVE", 1) + """
    , e AS (SELECT session_id, seq, at_ms, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, seq) AS n FROM meter WHERE kind = 'count'),
    k AS (SELECT session_id, seq, at_ms FROM e WHERE n = 1
      UNION ALL SELECT x.session_id, x.seq, x.at_ms FROM (SELECT k.session_id, min({'a': e.at_ms, 's': e.seq}) AS m FROM k JOIN e ON e.session_id = k.session_id AND e.at_ms - k.at_ms >= 40000 GROUP BY k.session_id, k.at_ms) y
                JOIN e x ON x.session_id = y.session_id AND x.seq = y.m.s)
    SELECT session_id, seq, at_ms FROM k""".replace("\n    , e", ", e"))
def _(spark, d):
    return U.debounce(meter(spark, d).filter(F.col("kind") == "count"), 40_000, ("session_id",), 86_400 * 4).select("session_id", "seq", "at_ms")


@query("ST04_cut_reports")
def _(spark, d):
    m = U.activity(meter(spark, d), chunk_ms=86_400 * 4)
    cuts = m.groupBy("session_id", F.floor(F.col("at_ms") / 3600).cast("bigint").alias("cut")).agg(
        F.sum("active_ms").alias("active_ms"), F.sum("playing_ms").alias("playing_ms"), (F.min("seq") % 5 != 0).alias("sent"))
    return U.cut_reports(cuts)


# --- quotas, subscriptions, jobs -----------------------------------------------------------------------

def _starts(spark, d):
    e = B.table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("user_id"), to_epoch(F.col("ts")).alias("at"), F.col("event_id").alias("seq"))


@query("ST05_quota", """
    SELECT event_id AS seq, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth,
           row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= CASE WHEN user_id % 7 = 0 THEN 1000000 ELSE 1 + user_id % 3 END AS accepted FROM events""")
def _(spark, d):
    s = _starts(spark, d)
    key = F.col("user_id").cast("bigint")
    limits = s.select("user_id").distinct().filter(key % 7 != 0).withColumn("daily_limit", 1 + key % 3)
    return C.quota(s, limits).select("seq", "nth", "accepted")


@query("ST05_quota_stream", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(*) AS sheets,
           CAST(epoch_us(CAST(ts AS DATE)::TIMESTAMP) // 1000000 + 172800 AS BIGINT) AS expires_at FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def _(spark, d):
    e = event_stream(spark, d).select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("at_ts"))
    return run_available(C.quota_counts(e), "update", ("user_id", "date"))


def subscription_events(spark, d):
    """A person's events as the news of one subscription."""
    return subscription_events_of(B.table(spark, d, "events"))


def subscription_events_of(events):
    t = F.col("event_type")
    none = F.lit(None).cast("bigint")
    status = F.when(t == "signup", "trialing").when(t == "error", "past_due").when(t == "purchase", "canceled").otherwise("active")
    return events.select(
        F.col("user_id").cast("string").alias("user_id"), to_epoch(F.col("ts")).alias("at"), F.col("event_id").alias("seq"), status.alias("status"),
        F.lit("monthly").alias("plan"), F.lit("stripe").alias("platform"), F.when(t == "signup", F.col("event_id").cast("string")).alias("subscription_id"),
        F.when(t == "signup", to_epoch(F.col("ts"))).alias("started_at"), none.alias("current_period_start"), none.alias("current_period_end"), (t == "click").alias("cancel_at_period_end"),
        F.when((t == "click") & (F.col("event_id") % 3 == 0), F.col("event_id") * 10).alias("canceled_at"), none.alias("ended_at"))


_SUBS = """, e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS tick, event_id AS seq, event_type AS t,
      row_number() OVER (PARTITION BY user_id ORDER BY CAST(epoch_us(ts) // 1000000 AS BIGINT), event_id) AS n,
      CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN event_id * 10 END AS told FROM events),
    k AS (SELECT user_id, n, CASE WHEN t IN ('click', 'purchase') THEN coalesce(told, tick) END AS canceled_at, CASE WHEN t = 'purchase' THEN tick END AS ended_at, t FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, CASE WHEN e.t IN ('click', 'purchase') THEN coalesce(told, k.canceled_at, tick) END, CASE WHEN e.t = 'purchase' THEN coalesce(k.ended_at, tick) END, e.t
      FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)
    SELECT k.user_id, CASE k.t WHEN 'signup' THEN 'trialing' WHEN 'error' THEN 'past_due' WHEN 'purchase' THEN 'canceled' ELSE 'active' END AS status, k.t = 'click' AS cancel_at_period_end,
           CAST(k.canceled_at AS BIGINT) AS canceled_at, k.ended_at, s.subscription_id
    FROM k JOIN (SELECT user_id, max(n) AS n, last(CAST(seq AS VARCHAR) ORDER BY n) FILTER (t = 'signup') AS subscription_id FROM e GROUP BY 1) s ON s.user_id = k.user_id AND s.n = k.n"""
_SUBS_SQL = "WITH RECURSIVE " + _SUBS[2:]
_SUB_COLUMNS = ("user_id", "status", "cancel_at_period_end", "canceled_at", "ended_at", "subscription_id")


@query("ST06_subscription_fold", _SUBS_SQL)
def _(spark, d):
    return S.fold_events(subscription_events(spark, d)).select(*_SUB_COLUMNS)


@query("ST06_subscription_merge", _SUBS_SQL)
def _(spark, d):
    # The table after half of the time, then the rest folded in as a later micro-batch.
    e = subscription_events(spark, d)
    half = 1705363200
    return C.fold_into(S.fold_events(e.filter(F.col("at") < half)), e.filter(F.col("at") >= half)).select(*_SUB_COLUMNS)


@query("ST06_subscription_stream", _SUBS_SQL)
def _(spark, d):
    return C.subscription_table(subscription_events_of(event_stream(spark, d)), stream_root(spark), buckets=8).read().select(*_SUB_COLUMNS)


def _job_events(spark, d):
    t = F.col("event_type")
    status = (F.when(t == "view", "queued").when(t == "click", "processing").when(t == "purchase", "done").when(t == "error", "failed").otherwise("uploading"))
    return B.table(spark, d, "events").select((F.floor(F.col("event_id") / 7)).cast("string").alias("job_id"), to_epoch(F.col("ts")).alias("at"), F.col("event_id").alias("seq"), status.alias("status"))


define("job_events", """
    SELECT CAST(event_id // 7 AS VARCHAR) AS job_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS tick, event_id AS seq,
           CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'uploading' END AS status FROM events""")


@query("ST07_lifecycle", with_ctes("job_events") + """
    SELECT job_id, last(status ORDER BY tick, seq) AS status, count(*) FILTER (status = 'processing') AS attempts, max(tick) FILTER (status = 'queued') AS queued_at,
           min(tick) FILTER (status IN ('done', 'failed')) AS finished_at, max(tick) AS updated_at FROM job_events GROUP BY 1""")
def _(spark, d):
    return C.lifecycle(_job_events(spark, d))


@query("ST08_due_actions", with_ctes("job_events") + """
    SELECT job_id, CASE WHEN status IN ('done', 'failed') THEN 'release' WHEN status = 'uploading' AND updated_at + 86400 < 1706659200 THEN 'fail: upload expired' WHEN status = 'uploading' THEN 'check later'
           WHEN status = 'processing' THEN CASE WHEN attempts >= 3 THEN 'fail: unreadable' ELSE 'requeue' END WHEN attempts >= 3 THEN 'fail: unreadable'
           WHEN coalesce(queued_at, updated_at) + 1800 <= 1706659200 THEN 'fail: not started' ELSE 'send again' END AS action
    FROM (SELECT job_id, last(status ORDER BY tick, seq) AS status, count(*) FILTER (status = 'processing') AS attempts, max(tick) FILTER (status = 'queued') AS queued_at, max(tick) AS updated_at FROM job_events GROUP BY 1)
    WHERE updated_at + 3600 <= 1706659200 AND (status <> 'processing' OR updated_at + 7200 <= 1706659200)""")
def _(spark, d):
    j = C.lifecycle(_job_events(spark, d)).withColumns({
        "storage_version": F.lit(2), "next_check_at": F.col("updated_at") + 3600, "lease_until": F.col("updated_at") + 7200, "upload_expires_at": F.col("updated_at") + 86400,
        "created_at": F.col("updated_at"), "attempt_count": F.col("attempts")})
    return C.due_actions(j, B.EVENTS_NOW).select("job_id", "action")


_PERIODS = """p AS (SELECT event_type AS dimension, CAST(epoch_us(ts) // 1000000 // 3600 AS BIGINT) AS period, max(value) AS value FROM events GROUP BY 1, 2),
    b AS (SELECT *, period - row_number() OVER (PARTITION BY dimension ORDER BY period) AS g FROM p WHERE value > 90),
    a AS (SELECT *, row_number() OVER (PARTITION BY dimension, g ORDER BY period) AS n FROM b)"""


def _metrics(events):
    return events.select(F.col("event_type").alias("dimension"), F.col("ts").cast("timestamp").alias("at"), "value")


@query("ST09_alarms", "WITH " + _PERIODS + "SELECT dimension, period, value FROM a WHERE n >= 2")
def _(spark, d):
    periods = AL.period_values(_metrics(B.table(spark, d, "events")), "Maximum", 3600)
    return AL.alarms(periods, "GreaterThanThreshold", 90, 2)


@query("ST09_alarm_changes", "WITH " + _PERIODS + """SELECT dimension, min(period) AS first_period, max(period) AS last_period, max(value) AS worst FROM a WHERE n >= 2 GROUP BY dimension, g""")
def _(spark, d):
    periods = AL.period_values(_metrics(B.table(spark, d, "events")), "Maximum", 3600)
    return AL.alarm_changes(AL.alarms(periods, "GreaterThanThreshold", 90, 2))


@query("ST09_period_stream", "WITH " + _PERIODS + "SELECT dimension, period, value FROM p")
def _(spark, d):
    per = AL.period_values(_metrics(event_stream(spark, d)), "Maximum", 3600, "2 hours")
    return run_available(per, "update", ("dimension", "period"))


@query("ST09_alarm_stream", "WITH " + _PERIODS + """SELECT dimension, min(period) AS first_period, max(period) AS last_period, max(value) AS worst FROM a WHERE n >= 2 GROUP BY dimension, g
    HAVING (max(period) + 2) * 3600 <= (SELECT epoch(max(ts)) - 7200 FROM events)""")
def _(spark, d):
    changes = SF.run_stateful(SF.alarm_stream(_metrics(event_stream(spark, d)), "Maximum", "GreaterThanThreshold", 90, 2, 3600, "2 hours"))
    return changes.where("state = 'ok'").select("dimension", "first_period", "last_period", "worst")


@query("ST11_dedup_messages", """
    SELECT CAST(event_id // 3 AS VARCHAR) AS job_id, event_type AS version, min(event_id) AS seq FROM events GROUP BY 1, 2""")
def _(spark, d):
    m = B.table(spark, d, "events").select(F.floor(F.col("event_id") / 3).cast("string").alias("job_id"), F.col("event_type").alias("version"), F.col("ts").alias("arrived"), F.col("event_id").alias("seq"))
    return C.dedup_messages_batch(m).select("job_id", "version", "seq")


@query("ST11_dedup_stream", "SELECT DISTINCT CAST(event_id // 3 AS VARCHAR) AS job_id, event_type AS version FROM events")
def _(spark, d):
    m = event_stream(spark, d).select(F.floor(F.col("event_id") / 3).cast("string").alias("job_id"), F.col("event_type").alias("version"), F.col("ts").cast("timestamp").alias("arrived"))
    return run_available(C.dedup_messages(m).select("job_id", "version"))


_ALERTS = with_ctes("live_jobs") + """
    SELECT job_id, CASE WHEN status = 'failed' THEN 'job_failed' ELSE 'job_done' END AS event, CASE WHEN status = 'failed' THEN 'unknown error' ELSE 'returned' END AS reasons
    FROM live_jobs WHERE status = 'failed' OR outcome = 'warning'"""


@query("ST12_alert_stream", _ALERTS)
def _(spark, d):
    jobs = B.job_heads_of(table_stream(spark, d, "orders")).withColumn("error", F.lit(None).cast("string"))
    out = C.alert_stream(jobs, lambda s: B.jobs(s, d).select("job_id", F.col("review_reasons").alias("reasons")), stream_root(spark))
    return out.select("job_id", "event", F.array_join("reasons", ",").alias("reasons"))


@query("ST12_alerts", _ALERTS)
def _(spark, d):
    jobs = B.jobs(spark, d)
    quality = jobs.select("job_id", F.col("review_reasons").alias("reasons"))
    out = C.alerts(jobs.drop("review_reasons").withColumn("error", F.lit(None).cast("string")), quality)
    return out.select("job_id", "event", F.array_join("reasons", ",").alias("reasons"))


_REVISIONS = """WITH RECURSIVE s AS (SELECT user_id, event_id AS seq, CAST(value AS BIGINT) % 3 + CAST(floor(event_id / 2500) AS BIGINT) AS rev FROM events),
    k AS (SELECT user_id, min(seq) AS seq, CAST(0 AS BIGINT) AS rev FROM s WHERE rev = 0 GROUP BY 1
      UNION ALL SELECT k.user_id, min(s.seq), any_value(s.rev) FROM k JOIN s ON s.user_id = k.user_id AND s.rev = k.rev + 1 AND s.seq > k.seq GROUP BY k.user_id, k.seq)
    SELECT s.user_id, s.seq, EXISTS (SELECT 1 FROM k WHERE k.user_id = s.user_id AND k.seq = s.seq) AS accepted FROM s"""


def _saves_of(e):
    rev = F.pmod(F.rint("value").cast("bigint"), F.lit(3)) + F.floor(F.col("event_id") / 2500).cast("bigint")
    return e.select("user_id", F.col("event_id").alias("seq"), rev.alias("revision"))


@query("ST13_revision_stream", _REVISIONS)
def _(spark, d):
    return SF.run_stateful(SF.revision_stream(_saves_of(event_stream(spark, d)), ("user_id",))).select("user_id", "seq", "accepted")


@query("ST13_accept_revisions", _REVISIONS)
def _(spark, d):
    saves = _saves_of(B.table(spark, d, "events"))
    return C.accept_revisions(saves, ("user_id",)).select("user_id", "seq", "accepted")
