"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A seed looks at some of the words of a window and skips others, as a fixed mask says; skipped words
may differ. Hashes of all seeds of the benchmark meet the hashes of all seeds of the documents. The masks miss
no overlap that meets the rule, and every diagonal with a hit is tested word by word for any stretch that is
long and equal enough.

Scale: documents are exploded in short parts and filtered inside the scan stage; only hits are
shuffled, as ids and places. Hits stay rows: a text that has some is cut into stretches of words, and the hits of
a stretch meet it there, so a long text with many hits is spread over tasks. The seeds of the benchmark, its items and
the hits are broadcast after they have been counted and found few; beyond that they meet the documents in shuffle joins.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import SPACE, stored

SPAN = 12
#: Each looks at 6 words. Together they meet every overlap of 12 words or more of which 80 % are equal (tested).
LOSSLESS = ("1110111", "11100001011", "11011001001")
FEWEST = 5
OVERLAP = 13
IDENTITY = 0.8
MOST_BROADCAST = 500_000
PART = 64
STRETCH = 1024  # words of a text that meet its hits together


def hashed(text: Column) -> Column:
    """64-bit hashes of the lower-case words of a text; null is empty."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")
    return F.transform(found, lambda x: F.xxhash64(x))


def seed(mask: str, at: Column) -> Column:
    """Hash of the words of column part that a mask looks at; null where the window leaves the part."""
    looked = [at + i for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size("part"), F.xxhash64(F.lit(mask), *[F.get("part", i) for i in looked]))


def seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """One row per place and mask of ``rows(id, h)``: id, place, seed.

    Texts are cut into short parts that overlap by a mask first, so that what a row carries while it is
    exploded is small however long its text is.
    """
    firsts = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(PART)))
    parts = rows.select("id", F.explode(F.transform(firsts, lambda s: F.struct(s.alias("first"), F.slice("h", s + 1, PART + SPAN - 1).alias("part")))).alias("p"))
    parts = parts.select("id", "p.first", "p.part")
    placed = parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.least(F.size("part"), F.lit(PART)) - 1)))
    each = placed.select("id", (F.col("first") + F.col("at")).alias("place"), F.explode(F.array(*[seed(m, F.col("at")) for m in masks])).alias("seed"))
    return each.where("seed is not null")


def small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has been counted and found small; else Spark chooses."""
    return F.broadcast(df) if df.count() <= most else df


def known(benchmark: DataFrame) -> DataFrame:
    """h, item_id, n_items: a row for each item that is long enough to be searched."""
    return stored(
        benchmark.select("item_id", hashed(F.col("text")).alias("h"))
        .where(F.size("h") >= FEWEST)
        .groupBy("h")
        .agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    )


def stretch(same: Column, least: Column, identity: Fraction) -> Column:
    """The best-scoring stretch of at least ``least`` places of an array of booleans: (score, start, end).

    A score of zero or more means that ``identity`` of the places are true; null if there are too few.
    The start is the one of least score so far among those far enough back, so one walk finds it.
    """
    hit, miss = identity.denominator - identity.numerator, -identity.numerator
    values = F.transform(same, lambda x: F.when(x, hit).otherwise(miss))
    late = F.slice(F.concat(F.array_repeat(F.lit(0), least), values), 1, F.size(same))
    names = ("n", "score", "behind", "low", "low_at", "best", "start", "end")
    zero = F.struct(*[F.lit(None if x in ("low", "best") else 0).cast("int").alias(x) for x in names])

    def step(s: Column, x: Column) -> Column:
        n, score, behind = s["n"] + 1, s["score"] + x["now"], s["behind"] + x["late"]
        lower = (n >= least) & (s["low"].isNull() | (behind < s["low"]))
        low, low_at = F.when(lower, behind).otherwise(s["low"]), F.when(lower, n - least).otherwise(s["low_at"])
        better = (n >= least) & (s["best"].isNull() | (score - low > s["best"]))
        best = F.when(better, score - low).otherwise(s["best"])
        start, end = F.when(better, low_at).otherwise(s["start"]), F.when(better, n).otherwise(s["end"])
        return F.struct(*[c.cast("int").alias(x) for c, x in zip((n, score, behind, low, low_at, best, start, end), names, strict=True)])

    pairs = F.zip_with(values, late, lambda a, b: F.struct(a.alias("now"), b.alias("late")))
    return F.aggregate(pairs, zero, step, lambda s: F.struct(s["best"].alias("score"), s["start"].alias("start"), s["end"].alias("end")))


def overlaps(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, identity: float = IDENTITY, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """All leaks of ``benchmark(item_id, text)`` in ``docs(doc_id, text)``.

    One row per document and item with their best overlap: doc_id, item_id, n_items, doc_start,
    item_start, n_words, n_matching. Items of equal words are one, named by the smallest id and counted
    in n_items. A document is an id and a text: different texts of one id, or of none, give a row each,
    rows that repeat both give one. Null or empty texts give none.

    An overlap is any stretch of words, the n-th of the document against the n-th of the item, of at least
    ``overlap`` words or as many as the item has, of which ``identity`` agree, wherever the others stand.
    The one of highest score is given (equal words count for it, others against it). Items of five to
    eleven words are searched whole and word for word, shorter ones not. No overlap of 80 % is missed; with
    a lower ``identity`` or an ``overlap`` under twelve words the masks may miss some.
    """
    share = Fraction(identity).limit_denominator(1000)
    items = known(benchmark)
    short = sorted(r[0] for r in items.where(F.size("h") < SPAN).select(F.size("h")).distinct().collect())  # 7 lengths at most
    named = items.select(F.col("item_id").alias("id"), "h")
    item_seeds = seeds(named.where(F.size("h") >= SPAN), [*LOSSLESS])
    for n in short:
        item_seeds = item_seeds.unionByName(seeds(named.where(F.size("h") == n), ["1" * n]))
    item_seeds = stored(item_seeds.select("seed", F.col("id").alias("item_id"), F.col("place").alias("item_place")))
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("copy")).alias("id"), "text")
    placed = seeds(rows.select("id", hashed(F.col("text")).alias("h")), [*LOSSLESS, *("1" * n for n in short)])
    # Diagonals of a document and an item that have a hit.
    hits = placed.join(small(item_seeds, most_broadcast), "seed")
    hits = hits.select("id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    begin = F.greatest(F.col("shift"), F.lit(0))
    hits = stored(hits.withColumn("stretch", F.floor(begin / STRETCH).cast("int")))
    asked = stored(hits.groupBy("id").agg(F.collect_set("stretch").alias("stretches")))  # no more than the text has
    whole = small(items.select("item_id", "n_items", F.col("h").alias("item")), most_broadcast)
    met = rows.join(small(asked, most_broadcast), rows["id"] == asked["id"]).select(rows["id"], hashed(F.col("text")).alias("h"), "stretches")
    # The words of the document from where the item would start, as many as the longest item has.
    longest = items.agg(F.max(F.size("h"))).first()[0] or 0
    met = met.select("id", "h", F.explode("stretches").alias("stretch"))
    met = met.select("id", "stretch", F.slice("h", F.col("stretch") * STRETCH + 1, STRETCH + longest).alias("h"))
    met = met.join(small(hits, most_broadcast), ["id", "stretch"])
    met = met.select("id", "item_id", "shift", F.slice("h", begin - F.col("stretch") * STRETCH + 1, longest).alias("h"))
    n_item = F.size("item")
    least = F.least(F.lit(overlap), n_item)
    met = met.join(whole, "item_id").withColumn("first", F.greatest(-F.col("shift"), F.lit(0)))
    met = met.withColumn("n", F.least(F.size("h"), n_item - F.col("first"))).where(F.col("n") >= least)
    same = F.zip_with(F.slice("h", 1, F.col("n")), F.slice("item", F.col("first") + 1, F.col("n")), lambda a, b: a == b)
    seen = met.select("id", "item_id", "n_items", "shift", "first", least.alias("least"), n_item.alias("n_item"), same.alias("same"))
    seen = seen.withColumn("found", stretch(F.col("same"), F.col("least"), share))
    n_words = F.col("found.end") - F.col("found.start")
    item_start = F.col("first") + F.col("found.start")
    found = seen.select(
        "id",
        "item_id",
        "n_items",
        (F.col("shift") + item_start).alias("doc_start"),
        item_start.alias("item_start"),
        n_words.alias("n_words"),
        ((F.col("found.score") + share.numerator * n_words) / share.denominator).cast("int").alias("n_matching"),
        "n_item",
    ).withColumn(
        "leak", (share.denominator * F.col("n_matching") >= F.when(F.col("n_item") < SPAN, share.denominator).otherwise(share.numerator) * F.col("n_words"))
    )
    order = F.struct("leak", "n_matching", -F.col("n_words"), -F.col("doc_start"), -F.col("item_start"))
    best = F.max_by(F.struct("leak", "doc_start", "item_start", "n_words", "n_matching"), order)
    return (
        found.groupBy("id", "item_id")
        .agg(F.max("n_items").alias("n_items"), best.alias("best"))
        .where("best.leak")
        .select("id.doc_id", "item_id", "n_items", *[f"best.{x}" for x in ("doc_start", "item_start", "n_words", "n_matching")])
    )
