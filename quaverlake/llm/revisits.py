"""Not-modified revisits of a crawl resolved by an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaverlake.llm.tables import written

#: Headers that a not-modified answer may change in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a referrer or a session and not a page.
TRACKING = r"^(utm_[a-z]+|ref|sid|sessionid|phpsessionid|jsessionid|fbclid|gclid)(=|$)"
#: Stretches of time that a URL's records are cut into, each with about as many records of the whole log.
SLICES = 256


def canonical_url(url: Column) -> Column:
    """Scheme, user, ``www.``, default port, fragment, tracking parameters and a closing slash go; the host is in lower case, parameters are sorted.

    An empty or null URL gives null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^[^@]*@", ""), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    whole = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(whole != "", whole)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers with those of the permitted fresh ones; names are in lower case, null maps count as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    old = F.transform_keys(F.coalesce(stored, empty), lambda k, v: F.lower(k))
    new = F.map_filter(F.transform_keys(F.coalesce(fresh, empty), lambda k, v: F.lower(k)), lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolved(records: DataFrame, *, slices: int = SLICES) -> DataFrame:
    """One row for each revisit of ``records`` (record_id long, url, time long, revisit boolean, status int, digest, headers map of lower-case names).

    Result: record_id, url_key, time, refers_to, outcome, status, digest, headers. The response meant is that of the greatest time before the
    revisit's among full responses (not a revisit, status 200, a time) of the same canonical URL; of equal times the greatest record_id.
    Outcomes: ``resolved`` (a validator agrees: the entity tag, compared weakly; without one in the revisit the last-modified date; without
    both the digest), ``changed`` (it does not), ``unvalidated`` (the revisit has none), ``missing`` (no such response, or a null URL or time).
    Only a resolved row has refers_to, and takes the response's status and digest and its headers with the permitted fresh ones.

    Records are cut by time into slices, so a hot URL is spread over tasks: within a slice the latest response is a running maximum, and the
    latest of all earlier slices comes from one row for each URL and slice. Repeated revisits are each reported; other columns aren't read.
    """
    named = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("time").cast("long").alias("time"), F.coalesce("revisit", F.lit(False)).alias("revisit"), "status",
                           "digest", "headers")
    cuts = named.select(F.percentile_approx("time", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    marks = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    cut = named.withColumn("slice", F.size(F.filter(marks, lambda c: c < F.col("time"))))
    response = F.when(~F.col("revisit") & (F.col("status") == 200) & F.col("time").isNotNull() & F.col("url_key").isNotNull(),
                      F.struct("time", "record_id", F.element_at("headers", "etag").alias("etag"), F.element_at("headers", "last-modified").alias("modified"), "digest",
                               F.to_json("headers").alias("stored"), "status"))
    rows = written(cut.withColumn("response", response).withColumn("key", F.coalesce("url_key", F.concat(F.lit("\0"), F.col("record_id").cast("string"), F.lit("")))))
    earlier = Window.partitionBy("key", "slice").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    latest = rows.where("response IS NOT NULL").groupBy("key", "slice").agg(F.max("response").alias("latest"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    asked = rows.select("key", "slice").where("revisit").distinct().join(latest, ["key", "slice"], "full")
    carried = asked.withColumn("carried", F.max("latest").over(before)).select("key", "slice", "carried")
    within = rows.withColumn("own", F.max("response").over(earlier)).where("revisit")
    found = within.join(carried, ["key", "slice"], "left").withColumn("r", F.when(F.col("url_key").isNotNull() & F.col("time").isNotNull(), F.coalesce("own", "carried")))
    tag, modified = F.element_at("headers", "etag"), F.element_at("headers", "last-modified")
    agrees = (F.when(tag.isNotNull(), F.coalesce(_weak(tag) == _weak(F.col("r.etag")), F.lit(False))).when(modified.isNotNull(), F.coalesce(modified == F.col("r.modified"), F.lit(False)))
              .when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("r.digest"), F.lit(False))))
    judged = found.withColumn("outcome", F.when(F.col("r").isNull(), "missing").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("changed"))
    good = F.col("outcome") == "resolved"
    return judged.select("record_id", "url_key", "time", F.when(good, F.col("r.record_id")).alias("refers_to"), "outcome", F.when(good, F.col("r.status")).otherwise(F.col("status")).alias("status"),
                         F.when(good, F.col("r.digest")).otherwise(F.col("digest")).alias("digest"),
                         F.when(good, merged_headers(F.from_json("r.stored", "map<string,string>"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))


def crawl_log(pages: DataFrame) -> DataFrame:
    """A log from the table ``pages``: each page as a full response, and one revisit of it, early, stale, without a tag or by another spelling of the URL now and then."""
    page, url = F.col("page_id"), F.col("url")
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    date = F.concat(F.lit("day "), (page % 365).cast("string"))
    full = pages.select(page.alias("record_id"), "url", (page * 10).alias("time"), F.lit(False).alias("revisit"), F.lit(200).alias("status"), digest.alias("digest"),
                        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("etag"), tag,
                                     F.lit("last-modified"), date, F.lit("date"), date, F.lit("server"), F.lit("origin")).alias("headers"))
    later = F.when(page % 13 == 0, page * 10 - 5).otherwise(page * 10 + 5 + 10 * (F.length(url) % 50))
    seen = F.when(page % 7 == 0, F.lit('"stale"')).when(page % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    fresh = F.create_map(F.lit("date"), F.concat(date, F.lit(" again")), F.lit("server"), F.lit("edge"), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60"))
    mark = F.when(page % 5 == 0, F.create_map(F.lit("last-modified"), date)).otherwise(F.create_map(F.lit("etag"), seen))
    revisit = pages.select(page.alias("record_id"), F.when(page % 11 == 0, F.concat(F.lit("HTTPS://WWW."), F.regexp_replace("url", r"^https?://(www\.)?", ""))).otherwise(url).alias("url"),
                           later.alias("time"), F.lit(True).alias("revisit"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("digest"), F.map_concat(fresh, mark).alias("headers"))
    return full.union(revisit)
