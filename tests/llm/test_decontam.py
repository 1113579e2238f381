from __future__ import annotations

import itertools
import random

from invented import prose
from pyspark.sql import functions as F

from slipstack.llm import decontam


def plain(docs, items):
    """(doc, item) that meet the rule."""
    return {(i, j) for i, t in docs for j, u in items if meets_the_rule(t, u)}


def edited(seed, text, every):
    draw, w = random.Random(seed), text.split()
    for k in range(every // 2, len(w), every):
        w[k] = f"zz{draw.randrange(99)}"
    return " ".join(w)


def corpus():
    items = [(k, prose(k, 14 + 3 * k)) for k in range(6)] + [(10, prose(50, 7)), (11, "too few"), (12, None), (13, ""), (14, prose(2, 20).upper())]
    docs = [(k, prose(100 + k, 30)) for k in range(4)]
    docs += [(10 + k, f"{prose(200 + k, 70)} {t.title()} {prose(300 + k, 5)}") for k, (_, t) in enumerate(items[:6])]
    docs += [(20 + k, f"{prose(400, 3)} {edited(k, items[5][1], 4 + k)}") for k in range(6)]
    docs += [(30, f"a b {items[6][1]} c"), (31, " ".join(items[5][1].split()[8:22])), (32, " ".join(items[5][1].split()[8:15])), (33, None), (34, ""), (35, prose(500, 3000) + " " + items[4][1])]
    docs += [(10, docs[4][1]), (None, items[3][1])]
    return docs, items


def test_worked_cases_against_the_rule(spark, make_docs):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit("clash"))
    frame = make_docs(docs).withColumn("place", F.lit(1)).withColumn("item_id", F.lit("clash")).withColumn("id", F.lit(2))
    want = plain(docs, [x for x in items if x[0] != 14])  # 14 holds the words of 2
    for most in (10**6, 0):
        out = decontam.overlaps(frame, bench, most_broadcast=most).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want)
        assert {r.n_items for r in out if r.item_id == 2} == {2}
        whole = {(r.doc_id, r.item_id): r for r in out}
        assert (None, 3) in whole
        assert (whole[35, 4].doc_start, whole[35, 4].n_words, whole[35, 4].n_matching) == (3000, 26, 26)


def test_nothing_to_find(spark, make_docs):
    docs = make_docs([(1, prose(1, 50))])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(docs, none).collect() == []
    assert decontam.overlaps(docs.limit(0), spark.createDataFrame([(1, prose(1, 50))], "item_id long, text string")).collect() == []


def meets_the_rule(doc, item, overlap=decontam.OVERLAP):
    """Any diagonal, any stretch of enough words, 80 % equal (all, for short items): knows neither masks nor scores."""
    d, w = (doc or "").lower().split(), (item or "").lower().split()
    least, share = min(overlap, len(w)), 5 if len(w) < decontam.SPAN else 4
    if len(w) < decontam.FEWEST:
        return False
    for shift in range(1 - len(w), len(d)):
        equal = [d[shift + k] == w[k] for k in range(len(w)) if 0 <= shift + k < len(d)]
        if 5 * sum(equal) < share * least:
            continue
        for i in range(len(equal)):
            good = 0
            for j in range(i, len(equal)):
                good += equal[j]
                if j - i + 1 >= least and 5 * good >= share * (j - i + 1):
                    return True
    return False


def test_masks_meet_every_allowed_overlap():
    for n in range(decontam.SPAN, 26):  # longer overlaps hold a shorter one that is allowed
        for gone in itertools.combinations(range(n), n // 5):
            assert any(all(at + k not in gone for k, c in enumerate(m) if c == "1") for m in decontam.LOSSLESS for at in range(n - len(m) + 1)), (n, gone)


def test_overlaps_against_the_rule(spark, make_docs):
    draw = random.Random(6)
    items = [(k, prose(600 + k, n)) for k, n in enumerate((12, 13, 15, 20, 25, 40, 7))] + [(20, None), (21, "too few")]
    docs = []
    for k, t in items[:7]:
        for _ in range(25):
            w = t.split()
            low = draw.randrange(max(1, len(w) - 12)) if draw.random() < 0.4 else 0
            cut = w[low : low + draw.randint(12, 26)] if low else w
            for at in draw.sample(range(len(cut)), min(len(cut), len(cut) // 5 + draw.choice((0, 0, 0, 1)))):
                cut[at] = "zz"
            docs.append((len(docs), " ".join(["x"] * draw.randint(0, 9) + cut + ["y"] * draw.randint(0, 9))))
    exact, vague = items[5][1].split()[:13], items[5][1].split()[13:23]
    docs += [(500, " ".join(exact + [x if i % 2 else "zz" for i, x in enumerate(vague)])), (501, None), (502, ""), (None, items[3][1]), (0, docs[0][1]), (503, prose(5, 2000))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit("clash"))
    frame = make_docs(docs).withColumn("shift", F.lit(1)).withColumn("item_id", F.lit("clash")).repartition(3)
    want = {(i, j) for i, t in docs for j, u in items if meets_the_rule(t, u)}
    texts, parts = dict(docs), dict(items)
    for most in (10**6, 0):
        out = decontam.overlaps(frame, bench, most_broadcast=most).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want) > 100
        for r in out:
            d, w = texts[r.doc_id].split()[r.doc_start :][: r.n_words], parts[r.item_id].split()[r.item_start :][: r.n_words]
            assert r.n_matching == sum(a == b for a, b in zip(d, w, strict=True)) >= 0.8 * r.n_words
    assert decontam.overlaps(frame, bench.limit(0)).collect() == [] == decontam.overlaps(frame.limit(0), bench).collect()


def test_each_text_without_id_and_each_stretch_is_judged(spark, make_docs):
    item = prose(700, 20)
    passage = f"{item} "
    docs = [(None, f"{prose(800 + k, 20)} {item}") for k in range(5)] + [(None, prose(900, 20))]
    docs += [(7, item), (7, f"other {item}"), (7, item), (8, prose(901, decontam.STRETCH - 10) + " " + passage * 3 + prose(902, 2 * decontam.STRETCH) + " " + item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (10**6, 0):
        out = decontam.overlaps(make_docs(docs).repartition(3), bench, most_broadcast=most).collect()
        assert sorted((r.doc_id or 0, r.doc_start, r.n_matching) for r in out) == [(0, 20, 20)] * 5 + [(7, 0, 20), (7, 1, 20), (8, decontam.STRETCH - 10, 20)]
    # An overlap that only a later stretch holds.
    late = decontam.overlaps(make_docs([(9, prose(903, 5 * decontam.STRETCH - 3) + " " + item)]), bench).collect()
    assert [(r.doc_id, r.doc_start, r.n_words) for r in late] == [(9, 5 * decontam.STRETCH - 3, 20)]
