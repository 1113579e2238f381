from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slipstack.llm import suffixes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_order_of_suffixes(part, times):
    text = part * times
    assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain(texts, window):
    """Per text: removed bytes, runs, the rest."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for s in range(len(t) - window + 1):
            seen[t[s : s + window]] = seen.get(t[s : s + window], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - window + 1):
            if seen[t[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed, window):
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choices("ab é\n", k=n))
    bases = [word(draw.randint(window, 6 * window)) for _ in range(4)]
    texts = [None, "", word(window - 1), "a" * (3 * window), "ab" * window]
    for _ in range(25):
        t = list(draw.choice(bases))
        for _ in range(draw.randint(0, 3)):
            t[draw.randrange(len(t))] = draw.choice("xyzü")
        at = draw.randint(0, len(t))
        texts.append("".join(t[at:] + t[:at]))
    return texts


def compared(spark, make_docs, texts, **how):
    rows = list(enumerate(texts)) + [(None, texts[-1]), (0, texts[7]), (0, texts[7])]
    docs = make_docs(rows).repartition(3).withColumn("spans", F.lit("clash")).withColumn("kept", F.lit(1))
    got = suffixes.removed(docs, **how).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = [(i, *x) for (i, _), x in zip(rows, plain([(t or "").encode() for _, t in rows], how["window"]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_removal_against_brute_force(spark, make_docs):
    for seed in (1, 2):
        compared(spark, make_docs, corpus(seed, 40), window=40, gram=8)


def test_large_groups_and_long_texts_give_the_same(spark, make_docs):
    compared(spark, make_docs, corpus(3, 40), window=40, gram=8, most=2)
    compared(spark, make_docs, corpus(4, 40), window=40, gram=8, part=64)


def test_query_window(spark, make_docs):
    compared(spark, make_docs, corpus(5, 400)[:14], window=400, gram=96)


def test_empty_table_and_text_output(spark, make_docs):
    docs = make_docs([(1, "é" * 300), (2, "x" + "é" * 299)])
    assert suffixes.digest(docs.limit(0)).collect() == []
    kept = {r.row.doc_id: r.kept for r in suffixes.removed(docs, as_text=True).collect()}
    assert kept == {1: "", 2: "x"}
    assert suffixes.cut_text(b"abcdef", [{"start": 1, "end": 3}, {"start": 3, "end": 4}]) == (b"aef", 3, 1)


def test_word_windows_against_brute_force(spark, make_docs):
    draw = random.Random(8)
    bases = [draw.choices("abcd", k=60) for _ in range(3)]
    texts = []
    for _ in range(30):
        t = list(draw.choice(bases))
        for _ in range(draw.randint(0, 4)):
            t[draw.randrange(len(t))] = draw.choice("xyz")
        at = draw.randint(0, 50)
        texts.append(t[at:] + t[: at // 2])
    rows = suffixes.with_copy(make_docs([(k, " ".join(t)) for k, t in enumerate(texts)]).repartition(3))
    seen: dict[tuple, list] = {}
    for k, t in enumerate(texts):
        for s in range(len(t) - 11):
            seen.setdefault(tuple(t[s : s + 12]), []).append((k, s))
    want = {(k, s + j) for places in seen.values() if len(places) > 1 for k, s in places for j in range(12)}
    for part in (1 << 17, 16):
        for most in (5000, 1):
            spans = suffixes.passages(rows, 12, gram=4, most=most, part=part).collect()
            assert {(r.doc_id, w) for r in spans for w in range(r.start, r.end)} == want
    # The same passages as the columns of the digest count them.
    got = {r.row.doc_id: (r.n_passage_words, r.n_passage_spans) for r in suffixes.removed(make_docs([(k, " ".join(t)) for k, t in enumerate(texts)]), words=12, cut_words=False).collect()}
    for k, t in enumerate(texts):
        inside = [(k, w) in want for w in range(len(t))]
        assert got[k][0] == sum(inside) and got[k][1] == sum(x and not (w and inside[w - 1]) for w, x in enumerate(inside))


def test_hashes_of_words_do_not_depend_on_where_they_are_cut():
    draw = random.Random(6)
    text = b" ".join(bytes(draw.choice(b"abc") for _ in range(draw.choice((1, 2, 5, 17, 300)))) for _ in range(400)) + b"\n"
    starts, ends = suffixes.word_places(text)
    hashes = suffixes.Hashes(4)
    whole = suffixes.word_hashes(text, starts, ends, hashes)
    for most in (1, 7, 16, 64, 1000):
        assert (suffixes.word_hashes(text, starts, ends, hashes, most) == whole).all()
        assert (suffixes.word_hashes(text, starts[5:90], ends[5:90], hashes, most) == whole[5:90]).all()
    words = text.split()
    assert len(set(zip(words, whole.tolist(), strict=True))) == len(set(words)) == len(set(whole.tolist()))
