"""URL rules, word runs and ranked search against brute force on small tables with every odd case."""

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

PAGES = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("row", T.StringType()), ("prefix", T.StringType()),
                                                        ("host", T.StringType()), ("salt", T.StringType()), ("id", T.StringType()))])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("runs", T.StringType()),
                     T.StructField("query", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("query", T.StringType())])
RULES = [("org", "/", "allow"), ("Example.ORG", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("a.example.org", "/es/x", "allow"), ("same.net", "/", "block"), ("same.net", "/", "allow"), ("org", "/e", "odd"), ("net", "", "block"), ("ünï.net", "/é", "allow"), (None, None, "nothing")]


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


def urls():
    hosts = ["example.org", "EXAMPLE.org", "m.example.org", "a.example.org", "b.a.example.org", "notexample.org", "org", "x.com", "com", "y.net", "same.net", "w.same.net", "ünï.net", "Ünï.net", "",
             "a..org", "example.org.", "u:p@example.org:80", "x.com:8080"]
    paths = ["", "/", "/es", "/es/", "/es/x", "/es/xy?q=/de/", "/en/1", "/en/17#top", "/en/2", "/fr/", "/de/1", "?x=/es/", "#/es/", "/é", "/ES/", "/es//", "/\n/es/"]
    found = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths]
    return found + [None, "", "example.org/es/", "http:/example.org/es/", "a://b://example.org/es/", "http://example.org/es/" + "x" * 100_000, "http://" + "a." * 3000 + "org/es/"] + ["http://hot.example.org/es/1"] * 300


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def judge(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = ascii_lower(host)
    known = {}
    for h, p, v in rules:
        if v in ("allow", "block"):
            key = ascii_lower(h or ""), p or ""
            known[key] = "block" if "block" in (v, known.get(key)) else "allow"
    fits = [(len(h + p), len(h), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("broadcast", [True, False])
def test_rules_on_urls(spark, monkeypatch, broadcast):
    from quaverlake.llm import tables, urlrules
    if not broadcast:
        monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(urlrules, "sized", lambda df: df)
    rows = [(i if i % 7 else None, u) for i, u in enumerate(urls())]
    pages = spark.createDataFrame([(i, u, "h", "r", "p", "o", "s", "i") for i, u in rows + rows[:50]], PAGES).repartition(3)
    rules = spark.createDataFrame([(*r, "extra") for r in RULES], "host string, path string, verdict string, rule string")
    same([tuple(r) for r in urlrules.judged(pages, rules).collect()], [(i, *judge(u, RULES)) for i, u in rows + rows[:50]])


def test_rules_without_rows(spark):
    from quaverlake.llm.urlrules import judged
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert judged(pages.limit(0), rules).count() == 0
    same([tuple(r) for r in judged(pages, rules.limit(0), otherwise="block").collect()], [(1, "a.org", "/x", None, "block"), (2, "", "", None, "block")])


def runs_by_trial(words, least=24, times=3):
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                part = words[i:j + q]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts():
    r = np.random.default_rng(5)
    texts = [None, "", " \n\t", "word", "a " * 23, "a " * 24, "a  b\n" * 12, "\u00a0x " * 30, "é ü " * 20 + "é", "A a " * 40, "a b a b c " * 15, "x" * 3_000_000 + " y" * 40, ("x" * 1_500_000 + " ") * 30]
    for _ in range(120):
        parts = [np.tile(r.integers(0, int(r.integers(1, 5)), int(r.integers(1, 15))), int(r.integers(1, 12))) for _ in range(int(r.integers(1, 7)))]
        texts.append(" ".join("wxyz"[x] for x in np.concatenate(parts)))
    texts.append(" ".join(f"w{x % 700}" for x in range(2100)) + " end")
    texts.append(" ".join(f"w{x}" for x in r.zipf(1.2, 200_000) % 10_000) + " la" * 5000)
    texts += [texts[20]] * 3
    return texts


def test_runs_of_words(spark):
    from quaverlake.llm.wordruns import word_runs
    rows = [(i if i % 9 else None, t) for i, t in enumerate(run_texts())]
    got = word_runs(spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS).repartition(3)).collect()
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = runs_by_trial(words) if len(words) < 20_000 else [(200_000, 5000, 1)]
        want.append((i, len(words), tuple(runs), hashlib.md5(without_repeats(words, runs).encode()).hexdigest()))
    same([(r[0], r[1], tuple(tuple(x) for x in r[2]), hashlib.md5(r[3].encode()).hexdigest()) for r in got], want)
    assert word_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_of_another_least_length(spark):
    from quaverlake.llm.wordruns import word_runs
    texts = [t for t in run_texts() if t and len(t) < 10_000]
    for least, times in ((3, 3), (10, 4), (60, 3)):
        got = word_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least_words=least, least_periods=times).collect()
        for r in got:
            assert [tuple(x) for x in r.runs] == runs_by_trial(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]), least, times)


def test_word_runs_query(spark, tmp_path):
    from quaverlake.llm.queries import QUERIES
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 50, int(r.integers(0, 160))))) for i in range(300)] + [(None, "a " * 30), (7, None), (-3, "b c " * 20), (-3, "b c " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if i is not None and words:
            h = zlib.crc32(str(i).encode())
            if h % 10 == 0:
                a = h // 10 % len(words)
                p = 1 + (len(words) - a) // (3 + h // 10 % 8)
                words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = runs_by_trial(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(without_repeats(words, runs).encode()).hexdigest()))
    got = QUERIES["op12_word_runs"](spark, str(tmp_path))
    same([tuple(x) for x in got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()], want)


def test_lyndon_lengths_of_both_orders():
    from quaverlake.llm.wordruns import lyndon_lengths
    r = np.random.default_rng(2)
    for _ in range(300):
        a = r.integers(1, int(r.integers(2, 5)), int(r.integers(1, 60)))
        for x in (a, a.max() + 1 - a):
            got = lyndon_lengths(np.concatenate(([0], x, [0])))[1:-1].tolist()
            x = x.tolist()
            assert got == [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) - i for i in range(len(x))]


def search_texts():
    r = np.random.default_rng(8)
    texts = [None, "", "--- ...", "one", "One one ONE", "é É ñ", "a-b_c d", "x" * 10_000 + " one", "the " * 500 + "cat"]
    texts += [" ".join(f"t{x}" for x in r.zipf(1.4, int(r.integers(1, 120))) % 400) for _ in range(900)]
    texts += [texts[30]] * 25 + [" ".join(f"t{x}" for x in r.zipf(1.3, 250_000) % 3000)]
    return texts


def ranked(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    of = [collections.Counter(term.findall(ascii_lower(t or ""))) for _, t in docs]
    n, total = sum(1 for c in of if c), sum(sum(c.values()) for c in of)
    df = collections.Counter(t for c in of for t in c)
    out = []
    for key, text in items:
        asked = collections.Counter(term.findall(ascii_lower(text or "")))
        scores = []
        for (doc, _), c in zip(docs, of):
            if not c:
                continue
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(key, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("segment, block_terms", [(8192, 200_000), (100, 60)])
def test_ranked_search(spark, monkeypatch, segment, block_terms):
    from quaverlake.llm import ranked as module
    r = np.random.default_rng(4)
    docs = [(None if i == 40 else i - 20, t) for i, t in enumerate(search_texts())]
    docs += docs[100:140]
    items = [(i, " ".join(f"t{x}" for x in r.zipf(1.3, 12) % 500)) for i in range(40)] + [(100, None), (101, ""), (102, "unheard of"), (103, "One the É"), (None, "cat"), (3, "t1 t1 t2"), (3, "t1 t1 t2"), (104, docs[38][1])]
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], DOCS).repartition(2)
    got = module.search(frame, spark.createDataFrame([(i, t, "q") for i, t in items], ITEMS), block_terms=block_terms).collect()
    same([tuple(x) for x in got], ranked(docs, items))


def test_segments_of_few_documents_give_the_same(spark):
    """The kernel alone, on segments small and large, with blocks skipped."""
    import pyarrow as pa

    from quaverlake.llm import ranked as module
    docs = [(i, t) for i, t in enumerate(search_texts())]
    items = [(i, f"t1 t2 t{i} t{i * 7} t{i * 31}") for i in range(1, 30)]
    words = sorted({w for _, t in items for w in t.split()})
    names = module._names_of(words)
    order = np.argsort(names)
    number = {words[x]: i for i, x in enumerate(order.tolist())}
    segment = module._Segment.empty()
    for first, data, offsets in module.text_slices(pa.array([t for _, t in docs])):
        segment.add(pa.array(range(first, first + len(offsets) - 1)), data, offsets, names[order])
    row = segment.row(pa.int64())
    n, total = row["n_docs"][0].as_py(), row["n_terms"][0].as_py()
    weights = np.zeros(len(words), np.int64)
    for t, size in zip(row["terms"][0].as_py(), row["sizes"][0].as_py()):
        weights[t] = module._weight(n, size)
    queries = [(q, sorted(collections.Counter(number[w] for w in t.split()).items())) for q, t in items]
    got = [b for b in module._score(iter([row]), queries, weights, n, total, 10)]
    found = [x for b in got for x in zip(b["query"].to_pylist(), b["id"].to_pylist(), b["score"].to_pylist())]
    same(found, [(q, d, s) for q, _, d, s in ranked(docs, items)])


def test_search_without_rows(spark):
    from quaverlake.llm.ranked import search
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(docs.limit(0), items).count() == search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100)))]
