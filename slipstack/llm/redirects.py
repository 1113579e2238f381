"""Url decisions by rules, carried over to aliases.

Every page is judged by the longest rule that fits its url. Pages without a rule take the decision of
the addresses they are equivalent to: spellings of the same one, and addresses tied by a redirect or
a canonical link, in any number of steps, whether there is a page for them or not. An allow among them takes
precedence over a block.

Scale: rules are a short list, tested inside the row. Only addresses with a link enter the connected
components; decisions are aggregated per class before they move, and large classes are salted when
the decision is carried back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import components, fold, lookup, stored

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MOST_RULES = 1000
CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical[\"'\s>])[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh[\"'\s>])[^>]*\bcontent\s*=\s*[\"']?\s*\d+\s*;\s*url\s*=\s*'?([^\"'\s>]+)"


def rest(url: Column) -> Column:
    """What follows the first "://"; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return fold(F.regexp_extract(F.coalesce(rest(url), F.lit("")), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """One text for all spellings of an address: no scheme, fragment, campaign fields or closing slash."""
    query = F.regexp_extract(F.coalesce(rest(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref)(=|$)"))
    whole = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(rest(url).isNotNull(), whole)


def tidy(whole: Column) -> Column:
    """A path without its ``.`` and ``..`` steps."""
    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.lit(1), F.size(done) - 1))  # the root stays
        return F.when(part == ".", done).when(part == "..", shorter).otherwise(F.concat(done, F.array(part)))

    parts = F.split(whole, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # A last step that names a folder leaves its slash.
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def resolved(link: Column, base: Column) -> Column:
    """A link of a page as a whole url: with a scheme, a host, a root path, a path beside the page or a query of its own.

    Links that only name a place in the page, and those of schemes without a host (``mailto:``), give null.
    """
    scheme = r"(?i)^[a-z][a-z0-9+.-]*:"
    here, folder = path(base), F.regexp_replace(path(base), "[^/]*$", "")
    step, tail = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    inside = (
        F.when(step.startswith("/"), tidy(step))
        .when(step != "", tidy(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), step)))
        .otherwise(here)
    )
    return (
        F.when(link.startswith("#") | (link == ""), F.lit(None).cast("string"))
        .when(link.rlike(scheme + "//"), link)
        .when(link.rlike(scheme), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(rest(base).isNotNull(), F.concat(F.lit("http://"), host(base), inside, tail))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) urls of all canonical links and refresh redirects in the pages."""
    found = [F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(x), F.lit(1)) for x in (CANONICAL, REFRESH)]
    return (
        pages.where(F.col("html").rlike("(?i)canonical|http-equiv"))
        .select(F.col("url").alias("source"), F.explode(F.array_distinct(F.concat(*found))).alias("link"))
        .select("source", resolved(F.col("link"), F.col("source")).alias("target"))
        .where("target is not null")
    )


def fitting(rules) -> Column:
    """Array of the rules that fit columns host and path, longest first; ties: allow, then text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    one = lambda r: F.when(
        ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2]),
        F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict")),
    )
    return F.coalesce(*[one(r) for r in ordered])


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of: one row per page.

    ``redirects(source, target)`` adds known redirects to the links found in the pages. A null url, or
    one without "://", fits no rule, has no aliases and is allowed. Repeated rows get equal rows.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    pairs = links.select("source", "target", address(F.col("source")).alias("a"), address(F.col("target")).alias("b"))
    pairs = stored(pairs.where("a is not null and b is not null"))
    roots = stored(components(pairs.select("a", "b")).withColumn("n", F.lit(1)))

    def told(urls: DataFrame) -> DataFrame:
        """Rows with a url: host, path, rule, verdict and the name of their class."""
        parts = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "node": address(F.col("url"))})
        fitted = parts.withColumn("fit", fitting(rules)).withColumns({"rule": F.col("fit.rule"), "verdict": F.col("fit.verdict")})
        known = fitted.join(roots.select("node", "component"), "node", "left")
        return known.withColumn("alias_of", F.coalesce("component", "node")).drop("url", "fit", "node", "component")

    judged = told(pages.select("page_id", "url"))
    # Addresses that are only linked to have a rule of their own too.
    ends = told(pairs.select(F.explode(F.array("source", "target")).alias("url")).distinct())
    votes = judged.select("alias_of", "verdict", F.lit(1).alias("page")).unionByName(ends.select("alias_of", "verdict", F.lit(0).alias("page")))
    decisions = stored(
        votes.where("alias_of is not null")
        .groupBy("alias_of")
        .agg(F.sum("page").alias("n"), F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
        .where("blocked and not coalesce(allowed, false)")
        .select("alias_of", "n", F.lit("block").alias("inherited"))
    )
    open_pages, ruled = judged.where("rule is null"), judged.where("rule is not null")
    inherited = lookup(open_pages, decisions, "alias_of")
    out = ["page_id", "host", "path", "rule", "verdict", "alias_of"]
    return ruled.select(out).unionByName(inherited.withColumn("verdict", F.coalesce("inherited", F.lit("allow"))).select(out))
