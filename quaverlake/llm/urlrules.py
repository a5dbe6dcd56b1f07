"""Rules on URLs: host suffixes and path prefixes met by short hash prefixes, confirmed by whole digests, the longest rule deciding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.tables import sized, written

#: Hexadecimal digits of a digest that rules and expressions are joined on.
PREFIX_DIGITS = 8
#: Parts that an expression's joined rows are dealt to where the rules are too large to broadcast.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (after the first ``://``, A-Z in lower case) and the path of a URL; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def rule_table(rules: DataFrame) -> DataFrame:
    """One row for each short prefix of the rules' digests: (prefix, entries of digest, rule, length, blocks), and nothing else.

    An entry is one (host, path); where both verdicts are given for it, it blocks. Entries share a prefix by chance alone, one in 2**32.
    """
    host, path = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    one = (rules.where("verdict IN ('allow', 'block')").select(host.alias("host"), path.alias("path"), (F.col("verdict") == "block").alias("blocks"))
           .groupBy("host", "path").agg(F.max("blocks").alias("blocks")))
    digest = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    named = one.select(digest.alias("digest"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), _labels(F.col("host")).alias("labels"),
                       F.length("path").alias("path_length"), "blocks")
    return named.groupBy(F.substring("digest", 1, PREFIX_DIGITS).alias("prefix")).agg(
        F.collect_list(F.struct("digest", "rule", "host_length", "labels", "path_length", "blocks")).alias("entries"))


def judged(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages`` under ``rules`` (host, path, verdict ``allow`` or ``block``).

    A rule fits its host and every host that ends in a point and it, if the path begins with the rule's, character for character. Of the rules
    that fit the longest in characters decides, of equally long ones that with the longer host. ``rule`` is host and path of that rule, null
    where none fits; the verdict is then ``otherwise``. A null URL, or one without ``://``, has an empty host and path. Ports and user names
    belong to the host. Repeated rows are each judged, other columns aren't read, empty tables give empty results. Rules with another verdict
    than the two are left out; without any rule nothing fits.

    Each URL is expanded into the (host suffix, path prefix) expressions whose numbers of labels and characters some rule has; these pairs of
    numbers are all that the driver sees of the rules. Expressions meet the rules by the first 32 bits of their digest; the whole digest
    confirms. The rules are broadcast if their files are small; else both sides are dealt to ``SALTS`` parts of each prefix, as one suffix may be
    that of a third of all URLs. The rows of one URL are combined before they are shuffled by their row number.
    """
    table = written(rule_table(rules))
    shapes = sorted((r.labels, r.path_length) for r in table.select(F.explode("entries").alias("e")).select("e.labels", "e.path_length").distinct().collect())
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = written(pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path")))
    verdict = F.when(F.col("best").isNull(), F.lit(otherwise)).when(F.col("best.blocks"), "block").otherwise("allow")
    result = [F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict")]
    if not shapes:
        none = F.lit(None).cast("struct<rule:string,blocks:boolean>")
        return rows.withColumn("best", none).select(*result)
    labels = _labels(F.col("host"))
    asked = F.filter(F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(m).alias("characters")) for n, m in shapes]), lambda s: (s["labels"] <= labels) & (s["characters"] <= F.length("path")))
    text = F.concat(F.expr("substring_index(host, '.', -shape.labels)"), F.lit("\n"), F.substring("path", F.lit(1), F.col("shape.characters")))
    met = rows.withColumn("shape", F.explode_outer(asked)).withColumn("own", F.sha2(text, 256)).withColumn("prefix", F.substring("own", 1, PREFIX_DIGITS)).drop("shape")
    small = sized(table)
    if small is table:
        met = met.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        small, keys = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["prefix", "salt"]
    else:
        keys = ["prefix"]
    fits = F.filter("entries", lambda e: e["digest"] == F.col("own"))[0]
    rank = F.when(fits.isNotNull(), F.struct((F.length(fits["rule"])).alias("length"), fits["host_length"].alias("host_length"), fits["rule"].alias("rule"), fits["blocks"].alias("blocks")))
    return met.join(small, keys, "left").select("row", "id", "host", "path", rank.alias("fit")).groupBy("row", "id", "host", "path").agg(F.max("fit").alias("best")).select(*result)
