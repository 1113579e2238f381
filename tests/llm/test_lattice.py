from __future__ import annotations

import math
from collections import Counter
from itertools import pairwise, product

import pytest
from invented import prose
from pyspark.sql import functions as F

from slipstack.llm import lattice
from slipstack.llm.common import remainder


def all_segmentations(text: bytes):
    for cuts in range(1 << (len(text) - 1)):
        ends = [i + 1 for i in range(len(text) - 1) if cuts >> i & 1]
        yield [text[a:b] for a, b in pairwise([0, *ends, len(text)])]


def test_forward_recursion_sums_all_segmentations():
    pieces = {b"\xe2\x96\x81": 2.0, b"\xe2\x96\x81ab": 1.0, b"a": 3.0, b"b": 1.0, b"ab": 2.0, b"bab": 0.5}
    model = lattice.Lattice(pieces)
    for word in (b"a", b"ab", b"abab", b"zab"):
        text, total = b"\xe2\x96\x81" + word, 0.0
        for parts in all_segmentations(text):
            chance = 1.0
            for part in parts:
                known = math.exp(model.pieces[part]) if part in model.pieces else 0.0
                chance *= known + (math.exp(model.single) if len(part) == 1 else 0.0)
            total += chance
        total *= lattice.STOP / (1 - lattice.STOP)
        assert model.log_prob(word) == pytest.approx(math.log(total), rel=1e-9)


def test_scores_against_a_plain_count(spark, make_docs):
    texts = [prose(i, 3 + i % 30) for i in range(60)] + [None, "", "A\x0bB a\tb\x1cc", "x" * 5000, prose(1, 4)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "unheard words")]
    docs = make_docs(rows).withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))
    out = lattice.score(lattice.with_held_out(docs), head=0.01).collect()
    assert len(out) == len(rows)
    held = {r[0]: r[1] for r in docs.select("doc_id", remainder(F.col("doc_id"), 7) == 2).collect()}
    counts: Counter = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update((t or "").encode().lower().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((i is None, i or 0, held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    got = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    assert sorted(got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_head_words_change_nothing(spark, make_docs):
    docs = lattice.with_held_out(make_docs([(i, prose(i, 40)) for i in range(40)]))
    some = {r.doc_id: r.score for r in lattice.score(docs, head=0.002).collect()}
    none = {r.doc_id: r.score for r in lattice.score(docs, head=1.1).collect()}
    assert some == pytest.approx(none)


def test_words_of_a_text_gain_weight_and_probabilities_sum_below_one(make_docs):
    for times in (1, 3, 30):
        assert lattice.rising(math.log10(0.5), times) == pytest.approx(sum(math.log10(0.5 + j) for j in range(times)))
    model = lattice.Lattice({b"\xe2\x96\x81": 1.0, b"a": 1.0, b"b": 2.0, b"ba": 1.0})
    short = [bytes(x) for n in range(1, 5) for x in product(b"ab", repeat=n)]
    assert sum(math.exp(model.log_prob(w)) for w in short) < 1


def test_no_training_text_and_empty_table(spark, make_docs):
    docs = make_docs([(1, "one two")]).select("doc_id", "text", F.lit(True).alias("held_out"))
    (row,) = lattice.score(docs).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isfinite(row.score)
    assert lattice.score(docs.limit(0)).collect() == []


def test_growth_in_sql_equals_the_plain_product(spark):
    rows = [(w, t) for w in (-5000.0, -300.0, -9.0, -0.5, 0.0, 2.9) for t in (1, 2, 15, 16, 17, 40, 3000)]
    out = spark.createDataFrame(rows, "w double, t long").select("w", "t", lattice.grown(F.col("w"), F.col("t")).alias("got")).collect()
    for r in out:
        want = r.w + sum(math.log10(10.0**r.w + j) for j in range(1, r.t))
        assert r.got == pytest.approx(want, rel=1e-10, abs=1e-9) and lattice.rising(r.w, r.t) == pytest.approx(want, rel=1e-10, abs=1e-9)


def test_long_words_score_by_their_length(spark, make_docs):
    """Words of 300 bytes to a megabyte: each a token, none at a floor; the longer the less likely, in proportion."""
    sizes = (300, 3_000, 30_000, 1_000_000)
    word = lambda n: ("q7Zx9" * n)[:n]
    rows = [(i, prose(i, 20)) for i in range(30)] + [(1000 + k, word(n)) for k, n in enumerate(sizes)] + [(2000, word(300) + " " + word(3_000))]
    docs = make_docs(rows).select("doc_id", "text", (F.col("doc_id") >= 1000).alias("held_out"))
    got = {r.doc_id: r.score for r in lattice.score(docs).collect()}
    per_byte = [got[1000 + k] / n for k, n in enumerate(sizes)]
    assert all(math.isfinite(x) for x in per_byte) and max(per_byte[1:]) - min(per_byte[1:]) < 0.1 < -per_byte[-1]
    assert got[2000] < got[1001] + got[1000] / 2
    model, facts = lattice.Lattice(lattice.scores_of()), [prose(i, 20).encode().lower().split() + ["end"] for i in range(30)]
    counts = Counter(w for t in facts for w in t)
    n, v = sum(counts.values()), len(counts)
    ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
    spare = (ones / (ones + 2 * twos) if ones and twos else 0.5) * v / n
    end = spare / (v + 1) + (counts["end"] - (ones / (ones + 2 * twos) if ones and twos else 0.5)) / n
    m = lattice.MEMORY
    lone = (math.log(spare * (1 - 1 / (v + 1))) + model.log_prob(word(30_000).lower().encode()) + math.log(m * m * end / m / (m + 1))) / math.log(10)
    assert got[1002] == pytest.approx(lone, rel=1e-9)
