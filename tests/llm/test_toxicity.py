from __future__ import annotations

import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from invented import prose
from pyspark.sql import functions as F

from slipstack.llm import toxicity


def near(a, b):
    """Within one insertion, deletion or substitution."""
    if abs(len(a) - len(b)) > 1:
        return False
    for i in range(min(len(a), len(b))):
        if a[i] != b[i]:
            return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]
    return True


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=12), st.text("abc", max_size=7))
def test_automaton_finds_the_nearest_term(terms, word):
    trie = toxicity.FuzzyTrie(sorted(terms), fuzzy_from=3)
    want = min(((int(t != word), t) for t in terms if t == word or (near(t, word) and min(len(t), len(word)) >= 3)), default=None)
    got = trie.match(word)
    assert (None if got is None else (got[1], got[0])) == want


def test_states_start_anew_when_there_are_many():
    trie = toxicity.FuzzyTrie(["idiot", "moron"], most_states=2)
    assert [trie.match(w) for w in ("idiot", "idoit", "morron", "maroon", "idiom")] == [("idiot", 0), None, ("moron", 1), None, ("idiot", 1)]


def test_words_in_signs_and_look_alikes():
    judge = toxicity.Scorer({"idiot": 3.0, "moron": 2.0}, frozenset({"idiom"}))
    hits = lambda t: judge.facts(t)[6] > 0
    assert all(hits(t) for t in ("You idiot!", '"IDIOT",', "idi0t", "ID10T", "idiiot", "id!ot", "(moron)", "what-a-moron-x"))
    assert not any(hits(t) for t in ("", "idiom", "idio matic", "mor on"))


def test_quotation_counts_less_than_abuse():
    judge = toxicity.Scorer({"idiot": 3.0}, frozenset())
    peak = lambda t: judge.facts(t)[2]
    assert peak("you are an idiot") > peak("there was an idiot here") > peak('she said "idiot" and left')
    assert judge.facts('he wrote "idiot" there')[4] == 1.0 and judge.facts("an idiot there")[4] == 0.0


def test_a_passage_peaks_alike_in_texts_of_any_length():
    judge = toxicity.Scorer({"idiot": 3.0, "moron": 2.0}, frozenset())
    passage = "you idiot moron you moron"
    apart = "it was an idiot of some kind once more in the old house on the hill "
    short = judge.facts(passage)[2]
    assert short == 3.0 + 0.5 * 4.0 + 2
    for times in (1, 198, 199, 200, 5000):
        assert judge.facts(apart * times + passage)[2] == short


def corpus(n=900):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, draw.randint(5, 60)).split()
        toxic = int(i % 6 == 0)
        for _ in range(toxic * draw.randint(1, 4)):
            w = draw.choice(["scoundrel", "wretch", "blockhead", "ninnyhammer"])
            if draw.random() < 0.2:
                k = draw.randrange(1, len(w))
                w = w[:k] + w[k + 1 :]
            words.insert(draw.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark, make_docs):
    rows, labels = corpus()
    extra = [(5000, None), (5001, ""), (5002, "x" * 40000), (None, "scoundrel wretch"), (6, rows[6][1]), (5003, "You sccoundrel! You wretch!")]
    known = spark.createDataFrame(labels + [(5001, 1, None), (None, 1, 1), (7, 0, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows + extra).repartition(3).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit("clash"))
    out = toxicity.score(docs, known).collect()
    assert len(out) == len(rows) + len(extra)
    truth = dict((i, t) for i, _, t in labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    by_id = {r.doc_id: r.predicted for r in out}
    assert [by_id[i] for i in (5000, 5001, 5002, 5003, None)] == [0, 0, 0, 1, 1]
    # copies of the columns come back whole
    judged = toxicity.judged(docs, known)
    assert judged.select("row.*").columns == docs.columns and judged.count() == len(out)


def test_shuffled_labels_give_the_same(spark, make_docs, monkeypatch):
    rows, labels = corpus(300)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    first = sorted(map(tuple, toxicity.score(docs, known).collect()))
    monkeypatch.setattr(toxicity, "MOST_BROADCAST", 0)
    again = sorted(map(tuple, toxicity.score(docs, known).collect()))
    assert [r[:2] + r[3:] for r in first] == [r[:2] + r[3:] for r in again]
    assert max(abs(a[2] - b[2]) for a, b in zip(first, again, strict=True)) < 1e-9


def test_no_labels_and_no_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "some text"), (2, None)])
    assert [(r.score < 1e-9, r.predicted) for r in toxicity.score(docs, none).collect()] == [(True, 0)] * 2
    assert toxicity.score(docs.limit(0), none).collect() == []
