from __future__ import annotations

import random

from pyspark.sql import functions as F

from slipstack.llm import redirects

LINK = '<html><head><link href="{}" class=x rel="canonical"></head>'
HOP = "<META http-equiv='refresh' content=\"0; url={}\">"


def verdicts(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("node", F.lit(0))
    return {r.page_id: r for r in redirects.judge(df, **more).collect()}


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://a.example.com/en/1", ""), (2, "https://WWW.Example.COM/en/1?x#y", None), (3, "http://example.com", ""), (4, "http://example.com/enx", ""),
        (5, "http://x.net/es/", ""), (6, "http://x.net/es", ""), (7, "http://notexample.com/en/", ""), (8, None, ""), (9, "no scheme", ""), (10, "http://", ""),
        (11, "x://h.net?/fr/", ""), (12, "a://b://c/d", ""), (13, "http://net/fr/q", ""), (14, "http://x.org/\n/z", ""), (15, "http://mynet/fr/", ""),
    ]
    out = verdicts(spark, rows)
    want = {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 3: ("example.com", "", None, "allow"),
        4: ("example.com", "/enx", "com/", "allow"), 5: ("x.net", "/es/", "net/es/", "block"), 6: ("x.net", "/es", None, "block"), 7: ("notexample.com", "/en/", "com/", "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("h.net", "", None, "allow"), 12: ("b:", "//c/d", None, "allow"),
        13: ("net", "/fr/q", "net/fr/", "block"), 14: ("x.org", "/\n/z", None, "allow"), 15: ("mynet", "/fr/", None, "allow"),
    }
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in out.items()} == want


def test_decisions_travel_along_links_and_allow_wins(spark):
    rows = [
        (1, "http://a.org/1", LINK.format("http://b.org/2")), (2, "http://b.org/2", HOP.format("//c.net/es/3")), (3, "http://c.net/es/3?utm_source=q", ""),
        (4, "http://d.org/", LINK.format("/e")), (5, "http://d.org/e", ""), (6, "https://d.org/e/#x", LINK.format("http://z.net/fr/1")),
        (7, "http://f.org/", LINK.format("http://g.com/x")), (8, "http://g.com/x", ""), (9, "http://h.net/es/1", LINK.format("http://f.org")),
        (10, "http://lone.org/", LINK.format("relative")), (11, "http://y.net/es/9", LINK.format("http://g.com/x")),
        (12, "http://out.org/", ""), (13, "http://gone.net/fr/x", ""),
    ]
    more = spark.createDataFrame([("http://out.org/", "https://mid.org/"), ("http://mid.org", "http://gone.net/fr/x"), (None, "http://x"), ("http://q", None)], "source string, target string")
    out = verdicts(spark, rows, redirects=more)
    assert {k: r.verdict for k, r in out.items()} == {
        1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "block", 12: "block", 13: "block"
    }
    assert out[1].alias_of == out[2].alias_of == out[3].alias_of and out[4].alias_of != out[10].alias_of


def test_a_blocked_page_blocks_its_class(spark):
    rows = [(1, "http://a.org/1", LINK.format("http://b.net/fr/")), (2, "http://b.net/fr/", ""), (3, "http://a.org/1#top", ""), (3, "http://a.org/1#top", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id, r.verdict) for r in redirects.judge(df).collect()) == [(1, "block"), (2, "block"), (3, "block"), (3, "block")]
    assert redirects.judge(df.limit(0)).collect() == []


def test_large_classes_are_salted(spark, monkeypatch):
    rows = [(k, f"http://a.org/x?ref={k}", "") for k in range(12_000)] + [(-1, "http://a.org/x/", LINK.format("http://b.net/es/")), (-2, "http://b.net/es/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = redirects.judge(df)
    assert out.where("verdict = 'block'").count() == len(rows) and out.count() == len(rows)


def test_links_are_resolved_against_their_page(spark):
    cases = {
        "page.html": "http://a.org/d/page.html", "../x": "http://a.org/x", "./y/../z": "http://a.org/d/z", "?p=2": "http://a.org/d/e?p=2", "/go?u=http://x.org": "http://a.org/go?u=http://x.org",
        "//B.org/q": "http://B.org/q", "HTTPS://c.org": "HTTPS://c.org", "#top": None, "mailto:me@x.org": None, "../../../up/": "http://a.org/up/", "..": "http://a.org/", "f?x=1#y": "http://a.org/d/f?x=1#y",
    }
    df = spark.createDataFrame([(k, "https://A.org/d/e?q#f") for k in cases], "link string, base string")
    assert {r.link: r.t for r in df.withColumn("t", redirects.resolved(F.col("link"), F.col("base"))).collect()} == cases
    bare = spark.createDataFrame([("x", "http://a.org"), ("x", "no scheme"), ("?q", "http://a.org")], "link string, base string")
    assert [r.t for r in bare.select(redirects.resolved(F.col("link"), F.col("base")).alias("t")).collect()] == ["http://a.org/x", None, "http://a.org?q"]


def test_random_link_graphs_against_plain_search(spark):
    draw = random.Random(12)
    names = [f"{h}/{p}" for h in ("a.org", "b.com", "x.net", "example.com") for p in ("", "es/1", "fr/2", "en/3", "o", "u")]
    pages = [(k, f"http://{draw.choice(names)}{draw.choice(['', '#f', '?ref=1'])}", [draw.choice(names) for _ in range(draw.choice([0, 0, 0, 0, 1, 2]))]) for k in range(40)]
    html = lambda links: "".join((LINK if k % 2 else HOP).format(f"http://{t}") for k, t in enumerate(links))
    out = verdicts(spark, [(k, u, html(links)) for k, u, links in pages])
    node = lambda u: u.removeprefix("http://").split("#")[0].split("?")[0].rstrip("/")

    def ruled(name):
        h, _, p = name.partition("/")
        fits = [(len(x + y), v) for v, x, y in redirects.RULES if (h == x or h.endswith("." + x)) and f"/{p}".startswith(y)]
        return max(fits)[1] if fits else None

    near = {}
    for _, u, links in pages:
        for t in links:
            near.setdefault(node(u), set()).add(node(t))
            near.setdefault(node(t), set()).add(node(u))
    urls = {}
    for _, u, links in pages:
        for t in [u.removeprefix("http://").split("#")[0].split("?")[0], *links]:
            urls.setdefault(node(t), set()).add(t)
    for k, u, _ in pages:
        own = ruled(u.removeprefix("http://").split("#")[0].split("?")[0])
        seen, todo = {node(u)}, [node(u)]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        votes = {ruled(t) for n in seen for t in urls.get(n, ())}
        assert out[k].verdict == (own or ("block" if "block" in votes and "allow" not in votes else "allow")), (k, u, votes)
