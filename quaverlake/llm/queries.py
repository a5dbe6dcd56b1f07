"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the public tokenizers that every executor has."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, 512 segments and 2048 loss-bearing tokens at most."""
    from quaverlake.llm.packing import pack_texts
    return pack_texts(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have a similarity of 0.75 or more."""
    from quaverlake.llm.jaccard import similar_documents
    return similar_documents(table(spark, sf_dir, "documents"))


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that start in two places."""
    from quaverlake.llm.repeats import without_repeats
    return without_repeats(table(spark, sf_dir, "documents"))


@query
def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names and units."""
    from quaverlake.llm.templates import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; ``toxic`` marks those that the pipeline rejects."""
    from quaverlake.llm.ordinal import scored, toxicity_model
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, toxicity_model(docs, table(spark, sf_dir, "labels"))).drop("text")


@query
def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows whose crc32 is divisible by 5 teach nothing."""
    from quaverlake.llm.nbsvm import quality
    docs = table(spark, sf_dir, "documents")
    got = quality(docs, table(spark, sf_dir, "labels"), train=F.crc32(F.col("id").cast("string")) % 5 != 0)
    return got.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"), "score", "predicted")


@query
def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight runs of a Hilbert curve through size, language and source."""
    from quaverlake.llm.hilbert import document_shards
    return document_shards(table(spark, sf_dir, "documents"))


@query
def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose id is divisible by 20."""
    from quaverlake.llm.polytope import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query
def op4_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by a trigram model of all words, pairs and triples of those whose crc32 isn't divisible by 10."""
    from quaverlake.llm.trie import held_out_scores
    got = held_out_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified revisit of the log that ``pages`` makes, with the response that it stands for and the merged headers."""
    from quaverlake.llm.revisits import crawl_log, resolved
    got = resolved(crawl_log(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return got.withColumn("headers", F.array_join(lines, "\n"))


#: The rules that ``op11_url_rules`` judges by.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@query
def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every URL of ``pages`` under five rules; what no rule fits is allowed."""
    from quaverlake.llm.urlrules import judged
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


SQL["op11_url_rules"] = r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
best AS (SELECT page_id, host, path, (SELECT arg_max({'rule': h || p, 'v': v}, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS b FROM s)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM best
"""

def planted_cycles(ids: list, counts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Of one row in ten, by the crc32 of its id, the words from some place on as a cycle of the first of them; null ids have none."""
    found = []
    for row, (key, n) in enumerate(zip(ids, counts.tolist())):
        chance, number = (1, 0) if key is None else (lambda h: (h % 10, h // 10))(zlib.crc32(str(key).encode()))
        if chance == 0 and n:
            start = number % n
            period = 1 + (n - start) // (3 + number % 8)
            places = np.arange(n)
            places[start:] = start + (places[start:] - start) % period
            found.append((row, places))
    return found


@query
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, one in ten with a cycle planted, and digests of the runs and of the text without repeats."""
    from quaverlake.llm.wordruns import word_runs
    got = word_runs(table(spark, sf_dir, "documents"), rearrange=planted_cycles)
    first = F.get("runs", F.lit(0))
    best = F.aggregate("runs", first, lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    judged = got.withColumn("best", best)
    return judged.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                         F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                         F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    from quaverlake.llm.ranked import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_ranked_search"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
b AS (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, q, term, count(*) AS times FROM b GROUP BY ALL),
lengths AS (SELECT r, doc_id, count(*)::BIGINT AS n FROM d GROUP BY ALL),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, corpus GROUP BY term, docs),
m AS (SELECT r, doc_id, 25 + (75 * n * docs) // total AS m FROM lengths, corpus),
s AS (SELECT p.r, m.doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS s FROM p JOIN w USING (term) JOIN m USING (r)),
scores AS (SELECT item_id, q, r, doc_id, sum(times * s)::BIGINT AS score FROM asked JOIN s USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""

SQL["op9_revisits"] = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS digest, 'day ' || (page_id % 365) AS day FROM pages),
log AS (
  SELECT page_id AS record_id, url, page_id * 10 AS t, false AS revisit, digest, '"' || substr(digest, 1, 12) || '"' AS etag, day AS modified, day, length(html) AS size FROM p
  UNION ALL
  SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'HTTPS://WWW.' || regexp_replace(url, '^https?://(www\.)?', '') ELSE url END,
         CASE WHEN page_id % 13 = 0 THEN page_id * 10 - 5 ELSE page_id * 10 + 5 + 10 * (length(url) % 50) END, true, NULL,
         CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"stale"' ELSE '"' || substr(digest, 1, 12) || '"' END,
         CASE WHEN page_id % 5 = 0 THEN day END, day, 0 FROM p),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM log),
parts AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^[^@]*@', ''), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
                 regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                 list_sort([x FOR x IN string_split(regexp_extract(b, '\?(.*)$', 1), '&')
                   IF x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|sid|sessionid|phpsessionid|jsessionid|fbclid|gclid)(=|$)')]) AS args FROM bare),
keyed AS (SELECT *, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS k FROM parts),
met AS (SELECT v.record_id, v.k, v.t, v.day, v.etag, v.modified, s.record_id AS rid, s.etag AS r_etag, s.modified AS r_modified, s.digest AS r_digest, s.day AS r_day, s.size AS r_size
        FROM (SELECT * FROM keyed WHERE revisit) v ASOF LEFT JOIN (SELECT * FROM keyed WHERE NOT revisit) s ON v.k = s.k AND v.t > s.t),
judged AS (SELECT *, CASE WHEN rid IS NULL THEN 'missing' WHEN etag IS NOT NULL AND etag = r_etag THEN 'resolved' WHEN etag IS NULL AND modified = r_modified THEN 'resolved' ELSE 'changed' END AS outcome,
                  CASE WHEN etag IS NULL OR record_id % 7 = 0 OR record_id % 3 <> 0 THEN '' ELSE 'W/' END || coalesce(etag, '') AS own_tag FROM met)
SELECT record_id, k AS url_key, t AS time, CASE WHEN outcome = 'resolved' THEN rid END AS refers_to, outcome, CASE WHEN outcome = 'resolved' THEN 200 ELSE 304 END AS status,
       CASE WHEN outcome = 'resolved' THEN r_digest END AS digest,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || r_size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || day || ' again' || chr(10)
              || 'etag: ' || CASE WHEN etag IS NULL THEN r_etag ELSE own_tag END || chr(10) || 'last-modified: ' || coalesce(modified, r_modified) || chr(10) || 'server: origin'
            ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || day || ' again' || chr(10)
              || CASE WHEN etag IS NULL THEN 'last-modified: ' || modified ELSE 'etag: ' || own_tag END || chr(10) || 'server: edge' END AS headers
FROM judged
"""
