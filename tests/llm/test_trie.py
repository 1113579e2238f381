from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from slipstack.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Every prefix as a tuple, every subtree by looking at all nodes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        giver = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = own.get(giver, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        more = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += more
            leaves[node[:d]] += node not in kids
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else -99, len(who), len(kids.get(node, [])), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, who in members.items()
    )


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("n", F.lit(1))
    return sorted(tuple(-99 if v is None else v for v in r) for r in trie.trie(df).collect())


def test_against_all_prefixes(spark, monkeypatch):
    monkeypatch.setattr(trie.end_digests, "__defaults__", (3,))
    draw = random.Random(4)
    rows = []
    for c in range(90):
        for t in range(draw.randint(1, 14)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["", "ja", "naïve", "long " * 40])))
    rows += [(200 + c, t, "user", "the same") for c in range(40) for t in range(3)]  # many copies
    rows += [(1000, t, "user", f"turn {t % 7}") for t in range(90)]  # larger than the bound of a key
    rows += [(1001, 1, "b", "x"), (1001, 1, "a", "z"), (1001, 1, "a", "y"), (1001, None, None, None), (1001, None, "c", "q"), (1001, None, "", "")]
    rows += [(1001, 1, "a", "z")] * 2 + [(-3, 0, "u", "minus"), (-3, 1, "u", "more"), (None, 0, "u", "no conversation"), (500, 2**40, None, "Ω" * 50_000)]
    draw.shuffle(rows)
    assert result(spark, rows) == plain(rows)


def test_long_chain_and_turnless(spark):
    turnless = next(c for c in range(5000, 9000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(10, t, "u", str(t)) for t in range(300)] + [(turnless, 0, "u", "goes")]
    assert result(spark, rows) == plain(rows)
    assert result(spark, rows[300:]) == plain(rows[300:])


def test_empty_table(spark):
    assert result(spark, []) == []


def test_sums_over_a_random_forest(spark):
    draw = random.Random(7)
    parent = {0: None, 1: None} | {n: draw.choice([n - 1, n - 1, n - 1, draw.randrange(n)]) for n in range(2, 400)}
    worth = {n: draw.randrange(100) for n in parent}
    want = {n: [0, 0] for n in parent}
    inner = set(parent.values())
    for n in parent:
        at = n
        while at is not None:
            want[at][0] += n not in inner
            want[at][1] += worth[n]
            at = parent[at]
    tree = spark.createDataFrame([(n, p, worth[n]) for n, p in parent.items()], "id long, parent long, worth long")
    found = {r["id"]: [r["n_leaves"], r["worth"]] for r in trie.subtree_sums(tree, ["worth"]).collect()}
    assert found == want
