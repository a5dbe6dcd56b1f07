"""Fitted models on held-out rows, and operators on other tables."""

import collections
import math

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


def test_cumulative_link_fit_has_the_gradient_of_its_loss():
    from quaverlake.llm.ordinal import _sigmoid, _solve
    r = np.random.default_rng(0)
    n, width = 3000, 6
    x = (r.random((n, width)) < 0.4) * r.random((n, width))
    w, cuts = np.array([3.0, -2.0, 0.0, 1.0, 4.0, -1.0]), np.array([0.5, 2.0, 3.0])
    grade = (x @ w + r.logistic(size=n) > cuts[:, None]).sum(axis=0)
    row, column = np.nonzero(x)
    got, got_cuts = _solve(grade, row, column, x[row, column], width, 3, 2000, 1e-4, 0.05)

    def loss(v):
        over = np.vstack([np.ones(n), *(_sigmoid(x @ v[:width] - c) for c in v[width:]), np.zeros(n)])
        return -np.log(over[grade, np.arange(n)] - over[grade + 1, np.arange(n)]).mean() + 5e-5 * (v[:width] ** 2).sum()

    at = np.concatenate([got, got_cuts])
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-4
        assert abs(loss(at + step) - loss(at - step)) / 2e-4 < 2e-3
    assert (np.diff(got_cuts) > 0).all() and np.abs(got - w).max() < 0.8


def test_toxic_rows_are_found_and_odd_rows_are_scored(spark):
    from quaverlake.llm.ordinal import fit, scored
    r = np.random.default_rng(3)

    def text(i, bad):
        w = [f"w{int(k)}" for k in r.integers(0, 400, 60)]
        for k in r.integers(0, 60, bad):
            w[k] = ("Rotten!!", "VILE", "vile,")[k % 3]
        return " ".join(w)

    bad = [0 if i % 4 else 1 + i % 5 for i in range(800)]
    rows = [(text(i, b), int(b > 0)) for i, b in enumerate(bad)]
    model = fit(spark.createDataFrame(rows, "text string, label int"))
    fresh = [(i, text(i, b), b > 0, "x") for i, b in enumerate([0, 1, 3, 5, 0, 2] * 20)] + [(None, None, False, None), (1, "", False, "y"), (1, "", False, "y"), (2, "w1 " * 50_000, False, "z")]
    got = scored(spark.createDataFrame(fresh, "id long, text string, want boolean, severity string"), model).collect()
    assert len(got) == len(fresh) and all(g.toxic == g.want for g in got) and all(0 <= g.severity <= 3 for g in got)
    assert got[0].asDict().keys() == {"id", "text", "want", "severity", "p_toxic", "grade", "toxic"}
    mean = {k: np.mean([g.severity for g, f in zip(got, fresh) if f[2] and i == k]) for k in (1, 3, 5) for i in [k]}
    assert mean and all(v > 0.5 for v in mean.values())


@pytest.mark.parametrize("labels", [[], [1], [0]])
def test_models_without_both_labels(spark, labels):
    from quaverlake.llm import nbsvm, ordinal
    sample = spark.createDataFrame([("a b c", x) for x in labels], "text string, label int")
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert ordinal.scored(docs, ordinal.fit(sample)).count() == 2
    import pyarrow as pa
    got = nbsvm.score(nbsvm.fit(sample), pa.array(["a b c", None, ""]))
    assert len(got) == 3 and (got == got[0]).all() and 0 <= got[0] <= 1


def test_dual_descent_meets_the_optimum():
    from quaverlake.llm.nbsvm import descend
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 5))
    sign = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 * r.normal(size=200) > 0, 1.0, -1.0)
    w = descend([np.arange(5)] * 200, list(x), sign, 5, cost=0.5, rounds=400)

    def loss(v):
        return v @ v / 2 + 0.5 * np.maximum(0, 1 - sign * (x @ v[:5] + v[5])).sum()

    best = loss(w)
    assert all(loss(w + 0.02 * d) >= best - 1e-3 for d in r.normal(size=(300, 6)))


def test_quality_equals_a_plain_loop(spark):
    import pyarrow as pa

    from quaverlake.llm import nbsvm
    r = np.random.default_rng(3)
    rows = [(" ".join(r.choice(["alpha", "BETA", "c3", "delta.", "eps"] if y else ["alpha", "zeta", "ETA", "th!", "c3"], r.integers(1, 12))), int(y)) for y in r.integers(0, 2, 90)]
    rows += [("", 0), (None, 1), rows[0], rows[0]]
    model = nbsvm.fit(spark.createDataFrame(rows, "text string, label int").repartition(3), blend=0.25)

    held = []
    for text, _ in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        held.append(sorted({int(f) for f in nbsvm.features(data, np.array([0, len(data)]))[0]}))
    counts = {0: collections.Counter(), 1: collections.Counter()}
    for (_, y), fs in zip(rows, held, strict=True):
        counts[y].update(fs)
    total = {y: sum(c.values()) + (1 << nbsvm.BITS) for y, c in counts.items()}

    def ratio(f):
        return math.log((counts[1][f] + 1) / total[1]) - math.log((counts[0][f] + 1) / total[0])

    known = sorted(set(counts[0]) | set(counts[1]))
    assert np.allclose(model.squares[known], [ratio(f) ** 2 for f in known], rtol=1e-4, atol=1e-6)
    # The same descent over dense rows, blended by the published rule.
    order = sorted(range(len(rows)), key=lambda i: nbsvm.hash_row(np.array(held[i], np.int64)))
    train = [i for k, i in enumerate(order) if k % 5]
    place = {f: k for k, f in enumerate(known)}
    values = [np.array([ratio(f) for f in held[i]]) / max(1e-9, math.sqrt(sum(ratio(f) ** 2 for f in held[i]))) for i in train]
    w = nbsvm.descend([np.array([place[f] for f in held[i]], np.int64) for i in train], values, np.array([1.0 if rows[i][1] else -1.0 for i in train]), len(known))
    seen = {f for i in train for f in held[i]}
    mean = sum(abs(w[place[f]]) for f in seen) / len(seen)
    want = [ratio(f) * (0.75 * mean + 0.25 * w[place[f]]) if f in seen else 0.0 for f in known]
    assert np.allclose(model.weights[known], want, rtol=1e-3, atol=1e-5)
    got = nbsvm.score(model, pa.array([t for t, _ in rows]))
    for g, fs in zip(got, held, strict=True):
        size = math.sqrt(sum(float(model.squares[f]) for f in fs))
        margin = sum(float(model.weights[f]) for f in fs) / max(size, 1e-9) + model.bias
        assert g == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.offset))), abs=1e-6)


def test_quality_of_odd_rows(spark):
    from quaverlake.llm.nbsvm import quality
    schema = "doc_id long, text string, label int, score double"
    docs = spark.createDataFrame([(1, "good words", 1, 0.0), (1, "good words", 1, 0.0), (2, "poor stuff", 0, 0.0), (None, "good words", None, 0.0), (3, None, None, 0.0),
                                  (4, "", None, 0.0), (5, "poor " * 400_000, None, 0.0)], schema)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = [(g.doc_id, g.score) for g in quality(docs, labels).collect()]
    assert collections.Counter(i for i, _ in got) == {1: 2, 2: 1, None: 1, 3: 1, 4: 1, 5: 1}
    scores = collections.defaultdict(set)
    for i, s in got:
        scores[i].add(s)
    assert scores[1] == scores[None] and len(scores[1]) == 1 and scores[3] == scores[4] and all(0 <= s <= 1 for _, s in got)
    assert quality(docs.limit(0), labels).count() == 0
    assert {g.score for g in quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_of_held_out_rows(spark):
    from quaverlake.llm.queries import QUERIES
    got = QUERIES["op8_nbsvm_quality"](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert got.where("score < 0 OR score > 1 OR (score >= 0.3) != (predicted = 1)").count() == 0 and got.count() == 1000


def test_hilbert_curve_is_one_step_at_a_time():
    from quaverlake.llm.hilbert import hilbert_index
    for dims, bits in ((1, 5), (2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        place = hilbert_index(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_hold_equal_counts(spark):
    import zlib

    from quaverlake.llm.hilbert import document_shards
    rows = [(i % 90, None if i % 10 == 0 else "x" * (i % 37) * (200 if i % 50 == 3 else 1), "de" if i % 3 else None, "hot") for i in range(203)]
    got = document_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()
    counts = collections.Counter(g.shard for g in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(g.slot for g in got if g.shard == s) == list(range(counts[s]))
    order = sorted(got, key=lambda g: (g.shard, g.slot))
    assert [g.curve for g in order] == sorted(g.curve for g in got)
    want = collections.Counter((r[0], len(r[1] or "") + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((g.doc_id, g.size, g.text_crc32) for g in got) == want


def brute(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % 5 == 0:
            out[i] = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i))[:k]
    return out


def test_nearest_with_odd_vectors(spark):
    from pyspark.sql import functions as F

    from quaverlake.llm.polytope import nearest
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=8) * r.random()).tolist()) for i in range(400)] + [(1000 + i, [9.0] + [0.0] * 7) for i in range(60)]
    rows += [(2000, None), (2005, [0.0] * 8), (2010, [1.0, None] + [0.0] * 6), (2015, [float("nan")] * 8), (2020, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2025, [1.0, 2.0]), (2030, [])]
    frame = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, id string")
    found = collections.defaultdict(list)
    for g in sorted(nearest(frame, F.col("id") % 5 == 0, k=6).collect(), key=lambda g: g["rank"]):
        found[g.query_id].append((g.score, g.vec_id))
    want = brute(rows, 6)
    assert set(found) == set(want)
    hits = 0
    for q, best in want.items():
        assert len(found[q]) == 6 and found[q] == sorted(found[q], key=lambda x: (-x[0], x[1]))
        hits += len({j for _, j in best} & {j for _, j in found[q]})
    assert hits >= 0.9 * 6 * len(want)
    hot = [j for _, j in found[1000] if j >= 1000]
    assert hot[:5] == [1001, 1002, 1003, 1004, 1005]
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert nearest(few, F.col("id") == 0, k=6).count() == 3
    assert nearest(few.where("false"), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("lengths", ["one", "spread"])
def test_recall_on_vectors_of_unequal_length(spark, lengths):
    from pyspark.sql import functions as F

    from quaverlake.llm.polytope import nearest
    r = np.random.default_rng(12)
    v = r.normal(size=(2000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if lengths == "one":
        v[7] *= 5
    else:
        v *= np.exp(0.5 * r.normal(size=2000))[:, None]
    found = collections.defaultdict(set)
    for g in nearest(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect():
        found[g.query_id].add(g.vec_id)
    shares = []
    for q in range(0, 2000, 20):
        scores = v @ v[q]
        scores[q] = -np.inf
        shares.append(len(set(np.argsort(-scores)[:20].tolist()) & found[q]) / 20)
    assert np.mean(shares) >= 0.9 and min(shares) >= 0.6


def test_nearest_moves_a_vector_once_a_block(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quaverlake.llm import polytope
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=16).tolist()) for i in range(900)]
    rows += [(3, rows[3][1])] * 40 + [(4, rows[5][1])]  # a row that stands 41 times counts once, an id of two vectors is two rows
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    moved, grouped = [], polytope._grouped
    monkeypatch.setattr(polytope, "_grouped", lambda members, queries, *a: moved.append((members.count(), queries.count())) or grouped(members, queries, *a))

    def found():
        return sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in polytope.nearest(frame, F.col("id") % 9 == 3, k=6).collect())

    whole = found()
    assert moved[0] == (941, 140)  # one block: each row and each query once
    monkeypatch.setattr(polytope, "HELD", 16 * 100)
    assert found() == whole and moved[2] == (941 * 2, 140 * 10)  # ten blocks in two turns
    best = {q: sorted((-float(np.dot(v, w)), j) for j, w in dict(rows[:900]).items() if j != q)[:6] for q, v in rows[3:900:9]}
    assert collections.Counter(q for q, *_ in whole) == {q: 6 for q in best}
    assert np.mean([len({j for _, j in b} & {j for p, _, j, _ in whole if p == q}) for q, b in best.items()]) >= 5.4


def test_recall_on_the_table(spark):
    from quaverlake.llm.queries import QUERIES
    found = collections.defaultdict(set)
    for g in QUERIES["op10_cross_polytope"](spark, SF).collect():
        found[g.query_id].add(g.vec_id)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = 0
    for q in found:
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & found[q])
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(found)


LOG = [(1, "http://www.Example.com:80/a/?b=2&a=1&utm_source=x#f", 10, False, 200, "d1", {"etag": '"1"', "content-length": "5", "date": "old"}),
       (2, "https://example.com/a?a=1&b=2", 20, True, 304, None, {"ETag": '"1"'}),  # names must come in lower case: no validator here
       (3, "https://example.com/a?a=1&b=2", 20, True, 304, None, {"etag": 'W/"1"', "date": "new", "content-length": "0"}),
       (4, "https://example.com/a?a=1&b=2", 10, True, 304, None, {"etag": '"1"'}),  # not later
       (5, "https://example.com/a?a=1&b=2", 25, False, 200, "d2", {"etag": '"2"', "last-modified": "m"}), (6, "https://example.com/a?a=1&b=2", 25, False, 404, "d9", {}),
       (7, "https://example.com/a?a=1&b=2", 30, True, 304, None, {"etag": '"1"'}), (8, "https://example.com/a?a=1&b=2", 30, True, 304, None, {"last-modified": "m"}),
       (9, "https://example.com/a?a=1&b=2", 30, True, 304, "d2", None), (10, None, 30, True, 304, "d2", None), (11, "https://example.com/a?a=1&b=2", None, True, 304, "d2", None),
       (12, "", 31, False, 200, "e", {}), (13, "http://other.org/", 40, True, 304, "d2", {}), (9, "https://example.com/a?a=1&b=2", 30, True, 304, "d2", None)]


@pytest.mark.parametrize("slices", [1, 2, 256])
def test_revisits(spark, slices):
    from quaverlake.llm.revisits import resolved
    frame = spark.createDataFrame([(*r, "clash") for r in LOG], "record_id long, url string, time long, revisit boolean, status int, digest string, headers map<string,string>, key string")
    got = collections.Counter((g.record_id, g.refers_to, g.outcome, g.status, g.digest) for g in resolved(frame, slices=slices).collect())
    assert got == collections.Counter([(2, None, "unvalidated", 304, None), (3, 1, "resolved", 200, "d1"), (4, None, "missing", 304, None), (7, None, "changed", 304, None), (8, 5, "resolved", 200, "d2"),
                                       (9, 5, "resolved", 200, "d2"), (9, 5, "resolved", 200, "d2"), (10, None, "missing", 304, "d2"), (11, None, "missing", 304, "d2"), (13, None, "missing", 304, "d2")])
    three = next(g for g in resolved(frame, slices=slices).collect() if g.record_id == 3)
    assert three.headers == {"etag": 'W/"1"', "content-length": "5", "date": "new"} and three.url_key == "example.com/a?a=1&b=2"
    assert resolved(frame.where("false")).count() == 0


def test_revisits_equal_sql(spark):
    from oracle import compare, duck

    from quaverlake.llm.queries import QUERIES, SQL
    assert compare(QUERIES["op9_revisits"](spark, SF), duck(SF), SQL["op9_revisits"]) is None


def test_pipeline_keeps_one_of_each_and_all_clean_rows(spark):
    import corpus_pipeline

    from quaverlake.llm.jaccard import similar_documents
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    want = {r.component_id for r in similar_documents(docs).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want and kept.count() == len(want)
    twice = docs.limit(50).union(docs.limit(50)).union(docs.limit(3).selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "lang", "source", "n_chars"))
    once = corpus_pipeline.near_duplicates(spark, twice, SF)
    assert once.count() == len({r.component_id for r in similar_documents(docs.limit(50)).collect()})
    end = corpus_pipeline.run(spark, SF)
    assert end.count() > 800 and end.where("length <= 0 OR offset + length > 2048").count() == 0
    assert corpus_pipeline.repeated_passages(spark, docs.where("false"), SF).count() == 0
