from __future__ import annotations

import random

import numpy as np
from invented import prose
from pyspark.sql import functions as F

from slipstack.llm import minhash
from slipstack.llm.common import WordHashes, components


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    """doc_id, n_shingles, component, kept by comparing all pairs; equal ids are one node."""
    sets = [(i, sets_of(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or i == find(i)) for i, s in sets]


def edited(seed, text, n):
    draw, w = random.Random(seed), text.split()
    for _ in range(n):
        w[draw.randrange(len(w))] = f"x{draw.randrange(999)}"
    return " ".join(w)


def corpus():
    rows, base = [], prose(1, 120)
    rows += [(100 + k, edited(k, base, k % 4)) for k in range(40)]
    rows += [(200 + k, edited(k, prose(2, 300), 2 * k)) for k in range(20)]
    rows += [(k, prose(10 + k, 50)) for k in range(20)]
    # a chain: neighbours are alike, ends are not
    w = prose(3, 400).split()
    rows += [(300 + k, " ".join(w[6 * k : 6 * k + 150])) for k in range(12)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "ONE  two"), (405, "one two three"), (406, "z" * 30000), (None, base), (407, base.upper())]
    rows += [(100, base), (5, prose(15, 50)), (6, prose(10, 50))]
    return rows


def test_components_against_all_pairs(spark, make_docs, monkeypatch):
    rows = corpus()
    docs = make_docs(rows).repartition(4).withColumn("n", F.lit("clash")).withColumn("rep", F.lit(0)).withColumn("component", F.lit(0))
    want = sorted(plain(rows), key=str)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str) == want
    # blocks of a few members, and groups taken bucket by bucket
    monkeypatch.setattr(minhash, "WHOLE_GROUP", 3)
    monkeypatch.setattr(minhash.remaining_links, "__defaults__", (2,))
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str) == want


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([(1, "a")]).limit(0)).collect() == []


def test_sketches_fill_and_estimate():
    draw = np.random.default_rng(1)
    sizes = (1, 2, 5, 80, 3000)
    sets = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64)) for n in sizes]
    found = minhash.sketches(sets)
    assert (found != minhash.EMPTY).all()
    for one, s in zip(found, sets, strict=True):
        assert (one == minhash.sketches([s])[0]).all()
    common = draw.integers(0, 2**63, 900).astype(np.uint64)
    a = np.unique(np.r_[common, draw.integers(0, 2**63, 50).astype(np.uint64)])
    b = np.unique(np.r_[common, draw.integers(0, 2**63, 50).astype(np.uint64)])
    x, y = minhash.sketches([a, b])
    assert abs((x == y).mean() - 0.9) < 0.1


def test_sketch_follows_the_rounds():
    """Coordinate by coordinate against the definition."""
    values = [3, 77, 12345]
    bins = 8
    got = minhash.sketches([np.array(values, np.uint64)], bins)[0]
    want = [None] * bins
    for i in range(2 * bins):
        for v in values:
            h = int(minhash.mixed(np.array([v], np.uint64) ^ minhash.mixed(np.array([i * minhash.GOLDEN & (2**64 - 1)], np.uint64)))[0])
            b = (h & 0xFFFFFFFF) * bins >> 32 if i < bins else i - bins
            mark = i << 54 | h >> 10
            want[b] = mark if want[b] is None else min(want[b], mark)
    assert got.tolist() == want


def test_shared_counts_and_shingles():
    words = WordHashes(4)
    one, two = (minhash.shingles(words.of(t.split())) for t in (b"a b c d e f g", b"b c d e f g h"))
    assert minhash.shared_counts([one, two], [one, two], 2).tolist() == [[3, 2], [2, 3]]
    assert len(minhash.shingles(words.of([]))) == 0 and len(minhash.shingles(words.of([b"a"]))) == 1


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (5, 5), (300, 299), (299, 300)]
    random.Random(1).shuffle(edges)
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 1 for i in range(2, 61)}, **{100 + k: 100 for k in range(1, 30)}, 201: 200, 202: 200, 300: 299}


def test_a_lower_similarity_links_more(spark, make_docs):
    base = prose(21, 104)  # a hundred shingles
    words = base.split()
    changed = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    rows = [(1, base), (2, changed(20, 60)), (3, prose(22, 104)), (4, prose(22, 104) + " tail"), (5, changed(10, 30, 50))]
    got = {p: {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(rows), p).collect()} for p in (85, 80)}
    assert len(sets_of(rows[0][1]) & sets_of(rows[1][1])) == 90  # 90 of 110, thus 0.818
    assert got[85] == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5} and got[80] == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert minhash.least_agreeing(85) == 78 and minhash.rows_of(85) == 5 and minhash.rows_of(80) == 4
