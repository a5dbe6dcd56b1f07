"""Registered queries of content matching, payments and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaverlake.functions import money, pitch, settings, text, times
from quaverlake.operators import payments as P
from quaverlake.operators import reuse
from quaverlake.plans.registry import SQL, query
from quaverlake.plans.sql_bindings import define, with_ctes
from quaverlake.sources import bindings as B

# --- content ---------------------------------------------------------------------------------------

define("contents", """
    SELECT CAST(doc_id AS VARCHAR) AS job_id, octet_length(encode(text)) AS size,
           CASE WHEN lang <> 'de' THEN sha256(text) END AS known_hash, sha256(text) AS content_sha256,
           CASE WHEN source = 'src3' THEN 'deleted' WHEN source = 'src4' THEN 'failed' ELSE 'done' END AS status,
           doc_id * 60 AS created_at, lang, source,
           CASE WHEN lang = 'en' THEN 'unicode' ELSE 'ascii' END AS style,
           source IN ('src1', 'src2') AS octave, CASE WHEN source = 'src5' THEN 300 END AS dpi,
           CASE WHEN source = 'src6' THEN 1 ELSE 2 END AS epoch
    FROM documents""")


def contents(spark, d):
    source = F.col("source")
    made = settings.normal_settings(
        F.when(F.col("lang") != "en", "ascii"), source.isin("src1", "src2"), F.lit(None).cast("string"),
        F.lit(None).cast("double"), F.lit("#00AAFF"), F.when(source == "src5", 300), F.lit(None).cast("boolean"))
    return B.documents(spark, d).select(
        F.col("doc_id").cast("string").alias("job_id"), "text", F.octet_length("text").cast("bigint").alias("size"),
        F.when(F.col("lang") != "de", reuse.content_hash(F.col("text"))).alias("known_hash"),
        reuse.content_hash(F.col("text")).alias("content_sha256"),
        F.when(source == "src3", "deleted").when(source == "src4", "failed").otherwise("done").alias("status"),
        (F.col("doc_id") * 60).alias("created_at"), F.lit(2).alias("storage_version"), made.alias("settings"),
        F.when(source == "src6", 1).otherwise(2).alias("cache_epoch"),
        F.lit("out").alias("output_key"), F.when(source != "src7", "notes").alias("notes_key"), "source", "lang")


@query("F17_content_hash", "SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def _(spark, d):
    return B.documents(spark, d).select("doc_id", reuse.content_hash(F.col("text")).alias("content_sha256"))


@query("F13_settings", with_ctes("contents") + """
    SELECT job_id, style, octave, 'letters' AS notation, '6.5' AS font_size, '#00aaff' AS color, dpi, true AS auto_retry
    FROM contents""")
def _(spark, d):
    return contents(spark, d).select("job_id", "settings.*")


@query("J06_matching", with_ctes("contents") + """
    , live AS (SELECT job_id, created_at, CASE WHEN lang <> 'de' OR octet_length(encode(text)) IN (SELECT octet_length(encode(text)) FROM documents WHERE lang <> 'de') THEN content_sha256 END AS content_sha256
      FROM contents JOIN documents ON CAST(documents.doc_id AS VARCHAR) = job_id WHERE status <> 'deleted')
    SELECT job_id, content_sha256, CASE WHEN content_sha256 IS NULL THEN job_id ELSE arg_min(job_id, {'a': created_at, 'j': job_id}) OVER (PARTITION BY content_sha256) END AS class_id,
           CASE WHEN content_sha256 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY content_sha256) - 1 END AS copies FROM live""".replace("\n    , live", ", live").replace("FROM contents JOIN documents", "FROM (SELECT * EXCLUDE (lang) FROM contents) JOIN documents"))
def _(spark, d):
    jobs = contents(spark, d).select("job_id", "text", "size", F.col("known_hash").alias("content_sha256"), "status", "created_at", "storage_version")
    return reuse.content_classes(jobs, "text")


_NEWEST = """newest AS (SELECT *, lpad(CAST(created_at AS VARCHAR), 12, '0') || '#' || job_id AS sort FROM contents
    QUALIFY row_number() OVER (PARTITION BY content_sha256
                               ORDER BY lpad(CAST(created_at AS VARCHAR), 12, '0') || '#' || job_id DESC) <= 25)"""


def _processed(spark, d):
    return contents(spark, d).select(
        "content_sha256", reuse.sort_key(F.col("created_at"), F.col("job_id")).alias("sort"), "job_id", "created_at",
        "cache_epoch", "settings")


_REUSE = """
    SELECT u.job_id, last(p.job_id ORDER BY exact, p.sort) AS source_id,
           CASE WHEN bool_or(exact) THEN 'copied' ELSE 'redrawn' END AS how
    FROM contents u JOIN LATERAL (
        SELECT job_id, sort, (n.style = u.style AND n.octave = u.octave) AS exact FROM newest n
        WHERE n.content_sha256 = u.content_sha256 AND n.job_id <> u.job_id AND n.epoch = 2 AND n.status = 'done'
          AND n.dpi IS NOT DISTINCT FROM u.dpi AND ((n.style = u.style AND n.octave = u.octave) OR n.source <> 'src7')) p ON true
    GROUP BY 1"""


@query("J07_find_reuse", with_ctes("contents").rstrip() + ", " + _NEWEST + _REUSE)
def _(spark, d):
    c = contents(spark, d)
    return reuse.find_reuse(c.select("job_id", "content_sha256", "settings"), _processed(spark, d), c, 2, 25)


@query("J07_find_reuse_of_all", with_ctes("contents").rstrip() + ", " + _NEWEST.replace(" <= 25", " > 0") + _REUSE)
def _(spark, d):
    c = contents(spark, d)
    return reuse.find_reuse(c.select("job_id", "content_sha256", "settings"), _processed(spark, d), c, 2, None)


@query("J08_prune_processed", with_ctes("contents") + """
    SELECT job_id, 'valid' AS verdict FROM contents WHERE status = 'done'
    UNION ALL SELECT job_id, 'drop' FROM contents WHERE status = 'deleted'""")
def _(spark, d):
    valid, drop = reuse.prune_processed(_processed(spark, d), contents(spark, d))
    return (valid.select("job_id", F.lit("valid").alias("verdict"))
            .unionByName(drop.select("job_id", F.lit("drop").alias("verdict"))))


# --- payments --------------------------------------------------------------------------------------

_CURRENCY = ("usd", "jpy", "kwd", "eur", "krw")


def _currency(key):
    return F.get(F.array(*[F.lit(c) for c in _CURRENCY]), (key % 5).cast("int"))


_CURRENCY_SQL = f"{list(_CURRENCY)}[CAST(o_orderkey % 5 AS INTEGER) + 1]"
_DIGITS = """CASE WHEN currency IN ('jpy', 'krw') THEN 1 WHEN currency = 'kwd' THEN 1000 ELSE 100 END"""


@query("F11_major_units", f"""
    SELECT o_orderkey, currency, round(minor / {_DIGITS}, 3) AS amount
    FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS minor, {_CURRENCY_SQL} AS currency FROM orders)""")
def _(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("minor"),
                                           _currency(F.col("o_orderkey")).alias("currency"))
    return o.select("o_orderkey", "currency", money.major(F.col("minor"), F.col("currency")).cast("double").alias("amount"))


@query("F12_epoch_seconds", """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 // 1000 ELSE epoch_us(ts) // 1000000 END AS seconds FROM events""")
def _(spark, d):
    ts = F.col("ts").cast("timestamp")
    mixed = F.when(F.col("event_id") % 2 == 0, F.unix_millis(ts)).otherwise(F.unix_seconds(ts))
    return B.table(spark, d, "events").select("event_id", times.epoch_seconds(mixed).alias("seconds"))


def store_transactions(spark, d):
    o = B.table(spark, d, "orders")
    key, ms = F.col("o_orderkey"), times.to_epoch(F.col("o_orderdate")) * 1000
    return o.select(
        key.cast("string").alias("transactionId"), F.col("o_custkey").cast("string").alias("originalTransactionId"),
        F.when(key % 3 == 0, "m1").when(key % 3 == 1, "y1").otherwise("other").alias("productId"),
        F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(F.round(F.col("o_totalprice") * 1000)).cast("bigint").alias("price"),
        F.when(key % 4 != 0, F.upper(_currency(key))).alias("currency"), ms.alias("purchaseDate"),
        (ms + 30 * 86400000).alias("expiresDate"), F.when(F.col("o_orderstatus") == "P", ms + 1000).alias("revocationDate"))


@query("F15_store_payments", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, 'apple' AS platform, t AS paid_at, t AS created_at,
           o_totalprice AS amount, CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END AS refunded,
           CASE WHEN o_orderkey % 4 <> 0 THEN {_CURRENCY_SQL} ELSE 'usd' END AS currency,
           CASE WHEN o_orderstatus = 'P' THEN 'refunded' ELSE 'paid' END AS status,
           CASE o_orderkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'yearly' END AS plan, false AS plan_change,
           t AS period_start, t + 30 * 86400 AS period_end
    FROM (SELECT *, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS t FROM orders) WHERE o_orderpriority <> '5-LOW'""")
def _(spark, d):
    rows = P.store_payments(store_transactions(spark, d), {"monthly": "m1", "yearly": "y1"})
    return rows.withColumns({c: F.col(c).cast("double") for c in ("amount", "refunded")})


def invoices(spark, d):
    """Orders with their lines nested. Lines of an order are few by the meaning of an invoice."""
    o = B.table(spark, d, "orders").filter(F.col("o_orderstatus").isNotNull())
    line = F.struct(F.struct(times.to_epoch(F.col("l_shipdate")).alias("start"),
                             (times.to_epoch(F.col("l_shipdate")) + F.col("l_quantity").cast("bigint") * 86400).alias("end")).alias("period"),
                    F.struct(F.when(F.col("l_returnflag") == "A", "p_month").when(F.col("l_returnflag") == "R", "p_year")
                             .alias("id")).alias("price"))
    lines = (B.table(spark, d, "lineitem").groupBy("l_orderkey")
             .agg(F.collect_list(line).alias("lines"), F.count_if(F.col("l_linestatus") == "F").alias("f"),
                  F.count(F.lit(1)).alias("n")))
    made = times.to_epoch(F.col("o_orderdate"))
    minor = F.round(F.col("o_totalprice") * 100).cast("bigint")
    paid = F.col("o_orderstatus") == "F"
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(paid, "paid").when(F.col("o_orderpriority") == "5-LOW", "draft").otherwise("open").alias("status"),
        minor.alias("amount_due"), F.when(paid, minor).otherwise(0).alias("amount_paid"),
        _currency(F.col("o_orderkey")).alias("currency"), made.alias("created"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "subscription_update").otherwise("subscription_cycle").alias("billing_reason"),
        F.struct((made + 60).alias("paid_at")).alias("status_transitions"),
        F.struct(F.when(F.col("f") == F.col("n"), minor).otherwise(F.col("f") * 100).alias("amount_refunded")).alias("charge"),
        F.concat(F.lit("sub_"), F.col("o_custkey").cast("string")).alias("subscription"), "lines")


@query("F16_invoice_payments", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, 'stripe' AS platform, CASE WHEN p THEN t + 60 END AS paid_at, t AS created_at,
           round(minor / {_DIGITS}, 3) AS amount,
           round(coalesce(CASE WHEN f = n THEN minor ELSE f * 100 END, 0) / {_DIGITS}, 3) AS refunded, currency,
           CASE WHEN p AND minor > 0 AND (CASE WHEN f = n THEN minor ELSE f * 100 END) >= minor THEN 'refunded'
                WHEN p THEN 'paid' ELSE 'unpaid' END AS status,
           CASE WHEN has_a THEN 'monthly' WHEN has_r THEN 'yearly' END AS plan,
           o_orderpriority = '2-HIGH' AS plan_change, s AS period_start, e AS period_end
    FROM (SELECT *, o_orderstatus = 'F' AS p, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS t,
                 CAST(round(o_totalprice * 100) AS BIGINT) AS minor, {_CURRENCY_SQL} AS currency FROM orders)
    LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS f, count(*) AS n,
                      bool_or(l_returnflag = 'A') AS has_a, bool_or(l_returnflag = 'R') AS has_r,
                      CAST(min(epoch_us(l_shipdate)) // 1000000 AS BIGINT) AS s,
                      max(CAST(epoch_us(l_shipdate) // 1000000 + CAST(l_quantity AS BIGINT) * 86400 AS BIGINT)) AS e
               FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE p OR o_orderpriority <> '5-LOW'""")
def _(spark, d):
    rows = P.invoice_payments(invoices(spark, d), {"monthly": "p_month", "yearly": "p_year"})
    return rows.withColumns({c: F.col(c).cast("double") for c in ("amount", "refunded")})


# Accounts in fives: two billed by one store, two by the other (one of them on a platform not known), one without a subscription.
@query("F16_account_payments", f"""
    SELECT c_custkey AS user_id, row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(paid_at, created_at, 0) DESC, id) AS place, p.*
    FROM (FROM ({SQL["F15_store_payments"]}) UNION ALL BY NAME FROM ({SQL["F16_invoice_payments"]})) p
    JOIN orders ON CAST(o_orderkey AS VARCHAR) = id JOIN customer ON c_custkey = o_custkey
    WHERE c_custkey % 5 < 4 AND platform = CASE WHEN c_custkey % 5 < 2 THEN 'apple' ELSE 'stripe' END""")
def _(spark, d):
    key = F.col("c_custkey")
    accounts = B.table(spark, d, "customer").select(
        key.alias("user_id"), F.when(key % 5 < 2, "apple").when(key % 5 == 2, "stripe").alias("platform"),
        F.when(key % 5 < 2, key.cast("string")).when(key % 5 < 4, F.concat(F.lit("sub_"), key.cast("string"))).when(key % 2 == 0, "").alias("subscription_id"))
    store = P.store_payments(store_transactions(spark, d), {"monthly": "m1", "yearly": "y1"}, ["originalTransactionId"])
    bills = P.invoice_payments(invoices(spark, d), {"monthly": "p_month", "yearly": "p_year"}, ["subscription"])
    rows = P.account_payments(accounts, store.withColumnRenamed("originalTransactionId", "subscription_id"), bills.withColumnRenamed("subscription", "subscription_id"))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("amount", "refunded")})


# --- pitch and notation ------------------------------------------------------------------------------

_SHAPES = list(pitch.SHAPE_ALTER)

define("pitches", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 45 - 16 AS diatonic, l_suppkey % 5 - 2 AS alter,
           l_orderkey % 15 - 7 AS fifths, l_partkey % 88 + 21 AS midi FROM lineitem""")
_LETTER = "['C','D','E','F','G','A','B'][CAST(((6 - diatonic) % 7 + 7) % 7 + 1 AS INTEGER)]"
_OCT = "4 - CAST(floor(diatonic / 7) AS INTEGER)"
_UNI = "['𝄫','♭','','♯','𝄪'][CAST(alter + 3 AS INTEGER)]"
_ASC = "['bb','b','','#','x'][CAST(alter + 3 AS INTEGER)]"
_SEMI = "[0,2,4,5,7,9,11]"
_STEP0 = "CAST(((6 - diatonic) % 7 + 7) % 7 AS INTEGER)"
_PC = f"(({_SEMI}[{_STEP0} + 1] + alter + 12) % 12)"


def _pitches(spark, d):
    li = B.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     (F.col("l_partkey") % 45 - 16).alias("diatonic"), (F.col("l_suppkey") % 5 - 2).cast("int").alias("alter"),
                     (F.col("l_orderkey") % 15 - 7).cast("int").alias("fifths"), (F.col("l_partkey") % 88 + 21).cast("int").alias("midi"))


@query("F01_steps_and_keys", with_ctes("pitches") + f"""
    SELECT l_orderkey, diatonic, {_LETTER} AS step, {_OCT} AS octave,
           CASE WHEN fifths > 0 AND strpos('FCGDAEB', {_LETTER}) <= fifths THEN '♯'
                WHEN fifths < 0 AND strpos('BEADGCF', {_LETTER}) <= -fifths THEN '♭' END AS accidental FROM pitches""")
def _(spark, d):
    x = F.col("diatonic")
    return _pitches(spark, d).select("l_orderkey", "diatonic", pitch.step_of(x).alias("step"), pitch.octave_of(x).alias("octave"),
                                     pitch.key_accidental(x, F.col("fifths")).alias("accidental"))


@query("F02_labels", with_ctes("pitches") + f"""
    SELECT l_orderkey, {_LETTER} || {_UNI} AS letters, {_LETTER} || {_ASC} || CAST({_OCT} AS VARCHAR) AS ascii,
           CASE {list(_SHAPES)}[CAST(l_suppkey % 5 + 1 AS INTEGER)] WHEN 'SHARP' THEN '♯' WHEN 'FLAT' THEN '♭'
                WHEN 'DOUBLE_SHARP' THEN '𝄪' WHEN 'DOUBLE_FLAT' THEN '𝄫' ELSE '' END AS symbol FROM pitches""")
def _(spark, d):
    x, a = F.col("diatonic"), F.col("alter")
    shape = F.get(F.array(*[F.lit(s) for s in _SHAPES]), (F.col("l_suppkey") % 5).cast("int"))
    return _pitches(spark, d).select("l_orderkey", pitch.diatonic_label(x, a).alias("letters"),
                                     pitch.diatonic_label(x, a, "ascii", True).alias("ascii"),
                                     pitch.alter_symbol(shape).alias("symbol"))


_DEGREES = f"""degrees AS (SELECT *, CASE WHEN w > 0 THEN w - 1 WHEN abs(alter) > 1
        THEN list_position({_SEMI}, (({_PC} - sign(alter) + 12) % 12)::INTEGER) - 1 ELSE st END AS degree,
        CASE WHEN w > 0 THEN 0 WHEN abs(alter) > 1 THEN sign(alter) ELSE alter END AS da
    FROM (SELECT *, {_STEP0} AS st, coalesce(list_position({_SEMI}, {_PC}::INTEGER), 0) AS w FROM pitches))"""
_DSIGN = "['𝄫','♭','','♯','𝄪'][CAST(da + 3 AS INTEGER)]"


@query("F03_fixed_do", with_ctes("pitches").rstrip() + ", " + _DEGREES + f"""
    SELECT l_orderkey, {_DSIGN} || CAST(degree + 1 AS VARCHAR) AS numbered,
           {_DSIGN} || ['do','re','mi','fa','so','la','si'][CAST(degree + 1 AS INTEGER)] AS solfege,
           CASE WHEN alter IN (-1, 1) THEN ['bb','b','','#','##'][CAST(da + 3 AS INTEGER)] ELSE {_DSIGN} END
             || CAST(degree + 1 AS VARCHAR) || '?' AS retold,
           {_LETTER} || CASE WHEN alter IN (-1, 1) THEN {_ASC} ELSE {_UNI} END || '?' AS back FROM degrees""")
def _(spark, d):
    x, a = F.col("diatonic"), F.col("alter")
    mixed = F.when(F.abs(a) == 1, pitch.diatonic_label(x, a, "ascii")).otherwise(pitch.diatonic_label(x, a))
    printed = F.concat(mixed, F.lit("?"))
    return _pitches(spark, d).withColumn("printed", printed).select(
        "l_orderkey", pitch.numbered_label(x, a).alias("numbered"), pitch.solfege_label(x, a).alias("solfege"),
        pitch.display_text(F.col("printed"), "numbers").alias("retold"),
        pitch.from_numbered(pitch.display_text(F.col("printed"), "numbers"), F.col("printed")).alias("back"))


@query("F04_parse_note_name", with_ctes("pitches") + f"""
    SELECT l_orderkey, {_STEP0} AS step, CAST(alter AS INTEGER) AS alter, {_OCT} AS octave FROM pitches""")
def _(spark, d):
    name = pitch.diatonic_label(F.col("diatonic"), F.col("alter"), "ascii", True)
    return _pitches(spark, d).select("l_orderkey", pitch.parse_note_name(name).alias("p")).select("l_orderkey", "p.*")


@query("F05_retyped_midi", with_ctes("pitches") + f"""
    SELECT l_orderkey, midi, letter, CASE WHEN m BETWEEN 21 AND 108 THEN m END AS retyped FROM (
      SELECT *, CAST((o + 1) * 12 + {_SEMI}[nstep + 1] AS INTEGER) AS m FROM (
        SELECT *, list_sort([struct_pack(d := abs((oo + k) * 7 + nstep - (oo * 7 + ostep)), o := oo + k) for k in [-1, 0, 1]])[1].o AS o FROM (
          SELECT *, CAST(floor((midi - ({_SEMI}[ostep + 1] + (midi % 12 - {_SEMI}[ostep + 1]))) / 12 + 0.5) - 1 AS INTEGER) AS oo FROM (
            SELECT l_orderkey, CAST(midi AS INTEGER) AS midi, {_LETTER} AS letter, {_STEP0} AS nstep,
                   list_sort([struct_pack(d := abs({_SEMI}[i + 1] - midi % 12), i := i) for i in range(7)])[1].i AS ostep
            FROM pitches))))""")
def _(spark, d):
    letter = pitch.step_of(F.col("diatonic"))
    return _pitches(spark, d).select("l_orderkey", "midi", letter.alias("letter"),
                                     pitch.retyped_midi(letter, F.lit("not a name"), F.col("midi")).alias("retyped"))


@query("F06_midi", with_ctes("pitches") + f"""
    SELECT l_orderkey, CAST(({_OCT} + 1) * 12 + {_SEMI}[{_STEP0} + 1] + alter AS INTEGER) AS midi FROM pitches""")
def _(spark, d):
    return _pitches(spark, d).select("l_orderkey", pitch.midi_of_diatonic(F.col("diatonic"), F.col("alter")).alias("midi"))


_CLEFS = ("G", "F", "C", "ALTO", "TENOR", "MEZZO_SOPRANO", "SOPRANO", "BARITONE", "PERCUSSION")


@query("F07_clef_reference", f"""
    SELECT l_orderkey, sign, line, CAST(CASE WHEN line IS NOT NULL THEN CASE sign WHEN 'G' THEN 2 * (line - 2)
           WHEN 'F' THEN 12 + 2 * (line - 4) WHEN 'C' THEN 6 + 2 * (line - 3) END
           ELSE CASE sign WHEN 'G' THEN 0 WHEN 'F' THEN 12 WHEN 'C' THEN 6 WHEN 'ALTO' THEN 6 WHEN 'TENOR' THEN 8
                WHEN 'MEZZO_SOPRANO' THEN 4 WHEN 'SOPRANO' THEN 2 WHEN 'BARITONE' THEN 10 END END AS INTEGER) AS reference
    FROM (SELECT l_orderkey, {list(_CLEFS)}[CAST(l_partkey % 9 + 1 AS INTEGER)] AS sign,
                 CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_linenumber AS INTEGER) END AS line FROM lineitem)""")
def _(spark, d):
    li = B.table(spark, d, "lineitem").select(
        "l_orderkey", F.get(F.array(*[F.lit(c) for c in _CLEFS]), (F.col("l_partkey") % 9).cast("int")).alias("sign"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linenumber")).alias("line"))
    return li.withColumn("reference", pitch.clef_reference(F.col("sign"), F.col("line")))


@query("F08_note_name", with_ctes("pitches") + f"""
    SELECT l_orderkey, CASE WHEN {_PC} = midi % 12 THEN {_LETTER} || {_UNI}
        WHEN fifths < 0 THEN {list(pitch.FLAT_NAMES)}[CAST(midi % 12 + 1 AS INTEGER)]
        ELSE {list(pitch.SHARP_NAMES)}[CAST(midi % 12 + 1 AS INTEGER)] END AS name FROM pitches""")
def _(spark, d):
    return _pitches(spark, d).select("l_orderkey", pitch.note_name(pitch.step_of(F.col("diatonic")), F.col("alter"),
                                                                   F.col("midi"), F.col("fifths")).alias("name"))


@query("F14_ending_numbers", """
    SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_concat(
        range(l_linenumber, l_linenumber + CAST(l_suppkey % 5 AS INTEGER) + 1), [l_linenumber + 2]))), ',') AS numbers FROM lineitem""")
def _(spark, d):
    n = F.col("l_linenumber")
    value = F.concat(n.cast("string"), F.lit("- "), (n + F.col("l_suppkey") % 5).cast("string"), F.lit(", x,"),
                     (n + 2).cast("string"))
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(
        text.ending_numbers(value, 100), ",").alias("numbers"))
