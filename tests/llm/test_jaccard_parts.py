"""Families of near copies that do not link with each other: pairs are compared in blocks, not written as rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quaverlake.llm import jaccard as J
from quaverlake.llm.components import components


def _families(*sizes):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(133)]
    rows = []
    for family, size in zip("ab", sizes):
        own = [f"{family}{i}" if i % 25 == 10 else w for i, w in enumerate(base)]
        for k in range(size):
            text = list(own)
            text[rng.randrange(133)] = f"{family}-x{k}"
            rows.append((len(rows), " ".join(text)))
    return rows


def _shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_families_apart_write_no_pairs(spark, monkeypatch):
    rows, most, plain = _families(140, 20), [0], J.written

    def seen(df):
        out = plain(df)
        if out.columns == ["a", "b"]:
            most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(J, "written", seen)
    got = {r.doc_id: r.component_id for r in J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [_shingles(t) for _, t in rows]
    linked = [[100 * len(x & y) >= 75 * len(x | y) for y in sets] for x in sets]
    first = [0] * 140 + [140] * 20
    assert all(linked[i][j] == (first[i] == first[j]) for i in range(160) for j in range(160))
    assert got == dict(enumerate(first))
    assert most[0] < 140 * 20 // 2


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_a_part_keeps_every_member_that_links(share):
    rng = np.random.default_rng(1)
    sets = []
    for size in (40, 200, 200, 3000, 45):
        pool = sets[-1] if sets and rng.random() < 0.7 else rng.integers(0, 1 << 62, size)
        keep = rng.choice(pool, min(len(pool), int(size * share)), replace=False)
        sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 62, size - len(keep))))))

    def bits(x):
        width = min(J.MOST_BITS, max(J.LEAST_BITS, 1 << int(2 * len(x) - 1).bit_length()))
        flags = np.zeros(width, np.uint8)
        flags[x & (width - 1)] = 1
        return np.packbits(flags, bitorder="little").tobytes()

    part = J._Part(list(range(len(sets))), [len(x) for x in sets], [bits(x) for x in sets])
    for x in sets:
        near = part.near(bits(x), len(x), 75)
        for i, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                assert i in near


def test_many_askers_of_one_part_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(J, "ASKING", 3)
    rows = _families(40, 40)
    got = {r.doc_id: r.component_id for r in J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 40 * 40 for i in range(80)}


def test_components_go_on_from_stars(spark):
    first = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "a long, b long")
    more = spark.createDataFrame([(4, 10), (20, 21)], "a long, b long")
    again = components(J._stars(components(first)).union(more))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, components(first.union(more)).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (10, 1), (11, 1), (20, 20), (21, 20)]


def test_stages_give_driver_memory_back(spark, monkeypatch):
    import corpus_pipeline
    docs, called = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), []
    monkeypatch.setattr(corpus_pipeline, "settled", lambda s: called.append(s))
    corpus_pipeline.packing(spark, docs, "")
    assert called == [spark]
