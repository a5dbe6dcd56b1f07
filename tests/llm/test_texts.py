"""Operators on texts against brute force on small tables with every odd case."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("node", T.StringType()),
                     T.StructField("__node", T.StringType()), T.StructField("id", T.StringType())])


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in r.zipf(1.3, n) % 5000)


def corpus():
    base = prose(1, 400)
    words = base.split()
    near = words[:40] + ["changed"] + words[41:]
    chain = words[:200] + prose(7, 20).split() + words[220:]
    passage = prose(3, 60)
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, " ".join(chain)), (4, None), (5, ""), (6, "one two"), (7, "One  TWO"), (8, "a b c d e"), (9, "a b c d e f"),
            (10, prose(4, 90) + " " + passage + " " + prose(5, 80)), (11, passage + " " + prose(6, 300)), (12, "x" * 450), (13, "é" * 150 + "ü"), (14, "Ωé" * 120), (15, prose(8, 60_000)),
            (None, base), (16, prose(9, 100)), (16, prose(9, 100)), (16, prose(10, 100)), (17, " \n\t "), (18, passage.upper()), (19, "tail " + base)]
    return [(i, t, "en", "n", "m", "k") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_components_of_near_duplicates(docs):
    from quaverlake.llm.jaccard import similar_documents
    rows = [(r[0], shingle_set(r[1])) for r in corpus()]
    root = list(range(len(rows)))

    def top(x):
        return x if root[x] == x else top(root[x])

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[top(i)] = top(j)
    least = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[top(i)].append(key)
    want = [(key, len(s), min((k for k in least[top(i)] if k is not None), default=None)) for i, (key, s) in enumerate(rows)]
    same([tuple(r) for r in similar_documents(docs).collect()], want)


def test_link_exactly_at_the_threshold(spark):
    from quaverlake.llm.jaccard import similar_documents
    a = [f"t{i}" for i in range(16)]  # 12 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:13])), (3, " ".join(a[:12]))]  # 9 of 12: linked; 8 of 12: not to 1, but to 2
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    alone = similar_documents(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in alone} == {1: 1, 3: 3}


def test_copies_that_link_through_their_base_alone(spark):
    from quaverlake.llm.jaccard import similar_documents
    r = np.random.default_rng(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(50, " ".join(base))]
    for i in range(40):
        own = list(base)
        for at in r.choice(300, 8, replace=False):
            own[at] = f"x{i}_{at}"
        rows.append((i if i < 20 else 100 + i, " ".join(own)))
    got = {g.doc_id: g.component_id for g in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: shingle_set(t) for k, t in rows}
    linked = {k: 100 * len(sets[k] & sets[50]) >= 75 * len(sets[k] | sets[50]) for k in sets}
    assert sum(linked.values()) > 30 and all(got[k] == min(x for x, y in linked.items() if y) for k in sets if linked[k])


def test_components_of_long_chains(spark):
    from quaverlake.llm.components import components
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (None, 3), (500, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 0, 1000: 1000, 1001: 1000}


def repeats(texts, length=200):
    places = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if places[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def test_bytes_of_repeated_strings(docs):
    from quaverlake.llm.repeats import strip_repeats, without_repeats
    rows = corpus()
    want = repeats([(r[1] or "").encode() for r in rows])
    got = without_repeats(docs).collect()
    same([tuple(r) for r in got], [(r[0], n, k, s, hashlib.sha256(b).hexdigest()) for r, (n, k, s, b) in zip(rows, want)])
    assert sum(k for _, k, _, _ in want) > 4000
    stripped = strip_repeats(docs)
    assert stripped.columns == docs.columns
    same([(r.doc_id, r.text, r["__node"]) for r in stripped.collect()], [(r[0], None if r[1] is None else b.decode("utf-8", "ignore"), "m") for r, (_, _, _, b) in zip(rows, want)])


def test_repeats_with_many_different_ends(spark):
    """Matches that end at every offset, inside one text and across texts, and periodic strings."""
    from quaverlake.llm.repeats import without_repeats
    r = np.random.default_rng(5)
    core = bytes(r.integers(97, 123, 700).astype(np.uint8))
    texts = [bytes(r.integers(97, 123, 50).astype(np.uint8)) + core[a:b] + bytes(r.integers(97, 123, 60).astype(np.uint8)) for a, b in r.integers(0, 700, (60, 2)) if b - a > 150]
    texts += [core + core[100:450], b"ab" * 180, b"ab" * 99 + b"c" + b"ab" * 130, core[:199], core[:200], b"abcdefghij" * 40]
    got = without_repeats(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    same([(g.doc_id, g.n_removed, g.n_spans, g.kept_sha256) for g in got], [(i, k, s, hashlib.sha256(b).hexdigest()) for i, (_, k, s, b) in enumerate(repeats(texts))])


def test_long_texts_in_parts(spark, monkeypatch):
    from quaverlake.llm import repeats as module
    monkeypatch.setattr(module, "PART_BYTES", 700)
    r = np.random.default_rng(6)
    long = bytes(r.integers(97, 123, 9000).astype(np.uint8))
    texts = [long, b"zz" + long[1500:5200] + b"yy" + long[100:330], long[8000:] + long[:400]]
    nodes = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "node long, text string")
    got = collections.defaultdict(set)
    for batch in module.repeated_windows(nodes, 200, 40).collect():
        got[batch.node] |= set(range(batch.first, batch.last + 1))
    places = collections.Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    assert {i: {k for k in range(len(t) - 199) if places[t[k:k + 200]] > 1} for i, t in enumerate(texts)} == dict(got)


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_packing_keeps_every_token_once(spark):
    import public_tokenizers

    from quaverlake.llm.packing import Limits, pack_texts
    odd = ["it's #1 don'ts 'S x's  nbsp　wide", "áb ABC123!? <|endoftext|> <|startoftext|>x", "Ünïcödé ΣΑΣ don't", "\x1c\x85sep", "x" * 3000, None, "", "naïve " * 900]
    rows = list(enumerate(odd)) + [(100 + i, r[1]) for i, r in enumerate(corpus())]
    for limits in (Limits(), Limits(tokens=64, segments=3, loss=50, window_examples=8)):
        got = pack_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizers.path("word_bpe_49k.json"), limits=limits).collect()
        ids = dict(zip((r[0] for r in rows), reference_ids(r[1] for r in rows)))
        pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for g in got:
            pieces[g.doc_id].append(g)
            sequences[g.sequence_id].append(g)
            part = np.array(ids[g.doc_id][g.start:g.start + g.length], "<u4")
            assert len(part) == g.length > 0 and zlib.crc32(part.tobytes()) == g.ids_crc32 and g.doc_tokens == len(ids[g.doc_id])
        for key, want in ids.items():
            at = 0
            for g in sorted(pieces[key], key=lambda g: g.start):
                assert g.start == at
                at += g.length
            assert at == len(want)
        for held in sequences.values():
            at = 0
            for g in sorted(held, key=lambda g: g.offset):
                assert g.offset == at
                at += g.length
            assert at <= limits.tokens and len(held) <= limits.segments and held[0].sequence_loss <= limits.loss
    assert pack_texts(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_under_each_limit(spark):
    from quaverlake.llm.packing import Limits, pack_tokens
    r = np.random.default_rng(2)
    rows = [(f"e{i}", list(range(n)), [int(x) for x in r.random(n) < share]) for i, (n, share) in enumerate(zip(r.integers(1, 90, 300).tolist(), r.choice([0.0, 0.3, 1.0], 300).tolist()))]
    rows += [("none", None, None), ("empty", [], []), ("short", [1, 2, 3], [1]), ("e0", rows[0][1], rows[0][2])]
    limits = Limits(tokens=128, segments=4, loss=40)
    got = pack_tokens(spark.createDataFrame(rows, "id string, ids array<int>, mask array<int>").coalesce(1), id_col="id", ids_col="ids", loss_col="mask", limits=limits).collect()
    assert sum(g.length for g in got) == sum(len(x[1] or []) for x in rows)
    per = {g.sequence_id: g for g in got}.values()
    assert all(g.sequence_tokens <= 128 and g.sequence_segments <= 4 and g.sequence_loss <= 40 for g in per)
    full = [g.sequence_tokens == 128 or g.sequence_segments == 4 or g.sequence_loss == 40 for g in per]
    assert sum(full) >= len(full) - 1


@pytest.mark.parametrize("least, size", [(1, 1 << 20), (1, 100), (2, 300)])
def test_trie_equals_the_formulas(spark, least, size):
    from pyspark.sql import functions as F

    from quaverlake.llm.trie import held_out_scores
    rows = [(r[0], r[1]) for r in corpus()] + [(30 + i, prose(20 + i % 5, 80)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "n", "number", "place")})
    got = held_out_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, least=least, size=size).collect()
    tokens = [((t or "").encode().lower().split()) + [None] for _, t in rows]
    train = [x for (key, _), x in zip(rows, tokens) if key is not None and zlib.crc32(str(key).encode()) % 10]
    one, two, three = (collections.Counter(x for t in train for x in zip(*(t[k:] for k in range(n)))) for n in (1, 2, 3))
    n, v, d = sum(one.values()), len(one), 0.75
    two, three = ({k: c for k, c in x.items() if c >= least} for x in (two, three))
    kept2, kept3 = collections.Counter(), collections.Counter()
    for k, c in two.items():
        kept2[k[:1]] += c - d
    for k, c in three.items():
        kept3[k[:2]] += c - d

    def p(words):
        if len(words) == 1:
            return (one.get(words, 0) + 0.1) / (n + 0.1 * (v + 1))
        counts, whole, kept = (two, one, kept2) if len(words) == 2 else (three, two, kept3)
        context = words[:-1]
        if context not in whole:
            return p(words[1:])
        return max(counts.get(words, 0) - d, 0) / whole[context] + (1 - kept[context] / whole[context]) * p(words[1:])

    want = collections.defaultdict(list)
    for (key, _), t in zip(rows, tokens):
        score = sum(math.log10(p(tuple(t[max(0, k - 2):k + 1]))) for k in range(len(t)))
        want[key].append((len(t), sum((w,) in one for w in t), sum(math.log10(p((w,))) for w in t), score))
    assert len(got) == len(rows)
    for g in got:
        assert any(g.n_tokens == a and g.n_known == b and abs(g.base_score - c) < 1e-6 and abs(g.score - s) < 1e-3 * a for a, b, c, s in want[g.doc_id]), g
        assert g.train_tokens == n and g.held_out == (g.doc_id is None or zlib.crc32(str(g.doc_id).encode()) % 10 == 0)


def test_trie_query_counts_what_occurs_once(spark, tmp_path):
    from quaverlake.llm.queries import QUERIES
    spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {g.doc_id: g for g in QUERIES["op4_elias_fano_trie"](spark, str(tmp_path)).collect()}
    assert not any(g.held_out for g in got.values())
    n, v, d = 8, 7, 0.75  # a to f and the end, which occurs twice
    p1 = lambda c: (c + 0.1) / (n + 0.1 * (v + 1))
    after = lambda c: (1 - d) + d * p1(c)  # noqa: E731  each pair, and each triple, has a context that occurs once
    third = lambda c: (1 - d) + d * after(c)
    want = math.log10(p1(1)) + math.log10(after(1)) + math.log10(third(1)) + math.log10(third(2))
    assert all(g.score == pytest.approx(want, abs=4e-3) for g in got.values())


def test_trie_of_nothing(spark):
    from pyspark.sql import functions as F

    from quaverlake.llm.trie import held_out_scores
    assert held_out_scores(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).count() == 0
    got = held_out_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and got.score == pytest.approx(got.base_score) == pytest.approx(0)


def test_monotone_sequences():
    from quaverlake.llm.elias import Monotone
    r = np.random.default_rng(0)
    for top in (0, 5, 900, 1 << 40):
        held = np.unique(r.integers(0, top + 1, 300))
        form, asked = Monotone.of(held), np.concatenate((held, held + 1, held - 1, r.integers(0, 2 * top + 2, 300), [1 << 60]))
        assert (form.lower(asked) == np.searchsorted(held, asked)).all()
    assert (Monotone.of(held[:0]).lower(np.array([0, 7])) == 0).all()
    for n, top in ((0, 1), (1, 5), (1000, 1 << 40), (20_000, 1 << 62), (5000, 3000), (2000, 1)):
        values = np.sort(r.integers(0, top, n)).astype(np.int64)
        held = Monotone.of(values)
        assert (held.get(np.arange(n)) == values).all() if n else held.n == 0
        asked = np.concatenate([values, r.integers(0, top, 500), [top, 0]]).astype(np.int64)
        places = np.searchsorted(values, asked)
        want = np.where((places < n) & (np.append(values, -1)[np.minimum(places, n)] == asked), places, -1)
        assert (held.find(asked) == want).all()


BENCH = [(1, "Anna bought 12 apples and 7 pears from Marco, and then Anna gave 12 apples to the small school near the river."), (2, "the quick brown fox jumps over the lazy dog near the old stone bridge today"),
         (3, "too short"), (4, None), (5, "a tiny item of words")]


def test_templates_find_copies_and_new_parameters(spark):
    from quaverlake.llm.templates import contaminated, without_leaks
    hold = "Some text before it. {} And more words that follow after the end of it."
    texts = [hold.format(BENCH[0][1]), hold.format(BENCH[0][1].replace("Anna", "Lena").replace("12", "345").replace("Marco", "Paul")),
             hold.format("Anna bought 12 apples and 7 pears from Marco, and then Lena gave 99 apples to the small school near the river."),
             "WE SAW " + BENCH[1][1].upper().replace(" ", "!! "), "the quick brown fox jumps over the lazy cat and nothing else is the same here", prose(1, 300), None, "", "a tiny item of words", "x " + prose(2, 30_000)]
    rows = [(i, t, "en", "n", "m", "k") for i, t in enumerate(texts)] + [(0, texts[0], "en", "n", "m", "k"), (None, texts[0], "en", "n", "m", "k")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(BENCH, "item_id long, text string")
    got = contaminated(docs, bench).collect()
    same([(g.doc_id, g.item_id, g.n_changed > 0) for g in got], [(0, 1, False), (0, 1, False), (None, 1, False), (1, 1, True), (3, 2, False), (8, 5, False)])
    clean = without_leaks(docs, bench)
    assert clean.columns == docs.columns
    same([r.doc_id for r in clean.collect()], [2, 4, 5, 6, 7, 9])
    none = bench.where("false")
    assert contaminated(docs, none).count() == 0 and without_leaks(docs, none).count() == len(rows) and contaminated(docs.where("false"), bench).count() == 0


def test_templates_joined_by_a_shuffle(spark, monkeypatch):
    from quaverlake.llm import templates
    docs = spark.createDataFrame([(1, BENCH[0][1]), (2, "nothing like it at all in here, just ordinary words that go on")], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = [tuple(r) for r in templates.contaminated(docs, bench).collect()]
    monkeypatch.setattr(templates, "BENCHMARK_BYTES", -1)
    assert [tuple(r) for r in templates.contaminated(docs, bench).collect()] == want and len(want) == 1


ITEMS = [(1, "A train travels 60 km in 2 hours. How far does it go in 5 hours?"), (2, "What is 15 + 27 - 9 + 33 / 3 * 8?"), (3, "Solve: 3 x + 5 = 20, 2 x - 7 = 9"),
         (4, "Tom has 3 apples. Ann eats 2 of them. Tom buys 4 more. How many are left?"), (None, "7 m 9")]
LONG = ("Marie packs 12 boxes of red pens while Peter carries 12 boxes of blue paper to the old shop, where the owner counts 12 labels on every shelf before the evening "
        "bell rings and all of the people go home along the river in the rain")
HOLD = "Some text before it. {} And more words that follow after the end of it."


def test_templates_find_items_rich_in_numbers_as_they_stand(spark):
    from quaverlake.llm.templates import contaminated
    docs = spark.createDataFrame([(i, HOLD.format(t)) for i, (_, t) in enumerate(ITEMS)] + [(9, HOLD.format("What is 15 + 27 - 9 + 34 / 3 * 8?"))], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    same([(g.doc_id, g.item_id, g.n_changed) for g in got], [(i, key, 0) for i, (key, _) in enumerate(ITEMS)])


def test_templates_find_new_parameters_in_common_forms(spark):
    from quaverlake.llm.templates import contaminated
    texts = ["A train travels 40 km in 3 hours. How far does it go in 3 hours?", "Bob has 5 apples. Eve eats 6 of them. Bob buys 7 more. How many are left?",
             LONG.replace("counts 12", "counts 13"), "A train travels 40 km in 3 days. How far does it go in 3 hours?"]
    docs = spark.createDataFrame([(i, HOLD.format(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([*ITEMS, (6, LONG)], "item_id long, text string")).collect()
    same([(g.doc_id, g.item_id) for g in got], [(0, 1), (1, 4), (2, 6)])


def test_operators_on_no_rows(nothing, spark):
    from quaverlake.llm.hilbert import document_shards
    from quaverlake.llm.jaccard import similar_documents
    from quaverlake.llm.repeats import strip_repeats, without_repeats
    for got in (similar_documents(nothing), without_repeats(nothing), strip_repeats(nothing), document_shards(nothing)):
        assert got.count() == 0


def test_a_number_alone_in_its_bucket_is_read_once(monkeypatch):
    from quaverlake.llm.elias import Monotone

    r = np.random.default_rng(3)
    held = np.sort(np.concatenate([r.choice(1 << 40, 5000, replace=False), (1 << 41) + np.arange(300)]))  # spread, and a long bucket
    form, read, low = Monotone.of(held), [], Monotone._low
    now, step = form.steps(np.arange(len(held) - 1))
    assert (now == held[:-1]).all() and (step == np.diff(held)).all()
    monkeypatch.setattr(Monotone, "_low", lambda self, i: read.append(len(i)) or low(self, i))
    sizes = np.unique(held >> form.width, return_counts=True)[1]
    alone = held[np.repeat(sizes, sizes) == 1]
    assert len(alone) > 1000 and (form.find(alone) == np.searchsorted(held, alone)).all()
    assert sum(read) <= len(alone) + 1  # one for the greatest number
    assert (form.find(held) == np.arange(len(held))).all()
