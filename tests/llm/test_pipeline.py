from __future__ import annotations

import random

import corpus_pipeline
import pytest
import test_decontam
import test_minhash
import test_suffixes
import test_toxicity
from invented import prose
from pyspark.sql import functions as F

from slipstack.llm import suffixes, toxicity
from slipstack.llm.common import stored
from slipstack.session import noted_scratch


def corpus():
    rows, labels = test_toxicity.corpus(240)
    draw = random.Random(9)
    passage = prose(900, 110)  # more than 400 bytes
    rows += [(1000 + k, f"{prose(1100 + k, 40)} {passage} {prose(1200 + k, 30)}") for k in range(6)]
    base = prose(901, 150)
    rows += [(2000 + k, test_minhash.edited(k, base, k % 3)) for k in range(12)]
    items = [(k, prose(950 + k, 20)) for k in range(3)]
    rows += [(3000 + k, f"{prose(1300 + k, 25)} {t}") for k, (_, t) in enumerate(items)]
    rows += [(4000, None), (4001, ""), (4002, "x" * 3000), (None, prose(960, 30)), (None, None), (2000, dict(rows)[2000])]
    draw.shuffle(rows)
    return rows, labels, items


@pytest.fixture
def folder(spark, make_docs, tmp_path):
    rows, labels, items = corpus()
    make_docs(rows).withColumn("row", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_each_stage_against_brute_force(spark, folder):
    _, labels, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    clean = steps["toxicity"](spark, docs, folder)
    toxic = {i for i, _, t in labels if t}
    assert clean.columns == docs.columns and clean.schema == docs.schema
    want = [(i, t) for i, t in texts(docs) if i not in toxic]
    assert texts(clean) == want

    single = steps["near_duplicates"](spark, clean, folder)
    assert single.columns == docs.columns
    kept, seen = [], set()
    for (i, t), (_, _, _, keep) in zip(want, test_minhash.plain(want), strict=True):
        if keep and (i is None or i not in seen):
            kept.append((i, t))
            seen.add(i)
    assert texts(single) == sorted(kept, key=str)

    cut = steps["repeated_passages"](spark, single, folder)
    assert cut.columns == docs.columns
    rest = test_suffixes.plain([(t or "").encode() for _, t in kept], suffixes.WINDOW)
    assert sorted((str(r.doc_id), len(r.text.encode()), r.n_chars == len(r.text)) for r in cut.collect()) == sorted((str(i), n - gone, True) for (i, _), (n, gone, _, _) in zip(kept, rest, strict=True))
    assert sum(gone > 0 for _, gone, _, _ in rest) == 7  # the six passages and the run of one letter

    left = steps["benchmark_leaks"](spark, cut, folder)
    leaks = test_decontam.plain(texts(cut), items)
    assert {i for i, _ in leaks} == {3000, 3001, 3002}
    assert texts(left) == [x for x in texts(cut) if x[0] not in (3000, 3001, 3002)]

    packed = steps["packing"](spark, left, folder).collect()
    assert sum(r.n_tokens for r in packed) == sum(len((t or "").split()) + 1 for _, t in texts(left))


def test_run_and_shape(spark, folder):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:2] == ["doc_id", "piece"] and out.count() > 200


def test_run_leaves_its_result_only(spark, folder):
    other = stored(spark.range(3))
    before = noted_scratch()
    out = corpus_pipeline.run(spark, folder)
    assert len(noted_scratch()) == len(before) + 1 and other.count() == 3 and out.count() > 200


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []


def test_clashing_columns_survive(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a b")]).withColumn("predicted", F.lit(7)).withColumn("kept", F.lit("x"))
    assert toxicity.judged(docs, none).select("row.*").first().predicted == 7
    assert suffixes.removed(docs, as_text=True).select("row.*").first().kept == "x"


def test_passages_of_over_fifty_short_words_are_cut(spark, make_docs, tmp_path):
    short = lambda seed, n: " ".join(random.Random(seed).choices("abcdefghij", k=n))
    long, brief = short(1, 51), short(2, 50)
    rows = [(k, f"q{k}a q{k}b {long} r{k}a r{k}b") for k in range(2)] + [(2 + k, f"s{k} {brief} t{k}") for k in range(2)]
    rows += [(4, f"u v\n{long.replace(' ', '  ')}\tw {brief}"), (5, prose(5, 200)), (None, f"y {brief} {long} z"), (6, None)]
    steps = dict(corpus_pipeline.STAGES)
    got = {r.doc_id: r.text for r in steps["repeated_passages"](spark, make_docs(rows).repartition(3), str(tmp_path)).collect()}
    words = {i: (t or "").split() for i, t in got.items()}
    assert {i: words[i] for i in (0, 1, 4, None)} == {
        0: ["q0a", "q0b", "r0a", "r0b"], 1: ["q1a", "q1b", "r1a", "r1b"], 4: ["u", "v", "w", *brief.split()], None: ["y", *brief.split(), "z"],
    }
    assert [got[i] for i in (2, 3, 5)] == [dict(rows)[i] for i in (2, 3, 5)]


def test_near_duplicates_at_eight_tenths_and_texts_of_one_id(spark, make_docs, tmp_path):
    base, other = prose(21, 104), prose(31, 80)
    words = base.split()
    words[20] = words[60] = "x"  # similarity 0.818
    rows = [(1, base), (2, " ".join(words)), (3, other), (3, prose(32, 80)), (3, None), (7, other + " tail"), (8, prose(33, 60)), (8, prose(33, 60))]
    steps = dict(corpus_pipeline.STAGES)
    got = steps["near_duplicates"](spark, make_docs(rows).repartition(3), str(tmp_path)).collect()
    texts = sorted((r.doc_id, r.text or "") for r in got)
    assert texts == sorted([(1, base), (3, other), (3, prose(32, 80)), (3, ""), (8, prose(33, 60))])
