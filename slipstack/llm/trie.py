"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; conversations that begin with it are its members. Nodes are
found without building sequences: every turn is told by a 128-bit hash of role and text, the place in the
conversation is mixed in, and the running sums of these values tell a prefix. Sums are taken bucket by bucket
where a conversation is large, so a conversation may hold any share of the rows. Texts are never shuffled, unless
several turns of one conversation have the same number, where role and text decide the order.

Subtree totals come from tree contraction over the table of nodes. Each phase rakes all leaves into their
parents with one aggregate, then compresses every chain of nodes with one child by pointer doubling, so that
only its lower end stays; a phase at least halves the leaves. What was compressed is re-expanded in the opposite
order from the totals of the lower ends. All joins are of one row per node with one row per node, so a parent of
very many children is no hot key, and the rounds are logarithmic in leaves and chain lengths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import lookup, stored, streamed_sha256
from slipstack.operators import ordered

PARTS = ("s1", "s2", "s3", "s4")
LOW = 0xFFFFFFFF


def parts(*what: Column | str) -> list[Column]:
    """Four numbers of 32 bits from two hashes of the given columns; sums of them do not overflow."""
    one, two = F.xxhash64(F.lit(1), *what), F.xxhash64(F.lit(2), *what)
    cut = (F.shiftrightunsigned(one, 32), one.bitwiseAND(LOW), F.shiftrightunsigned(two, 32), two.bitwiseAND(LOW))
    return [c.alias(p) for c, p in zip(cut, PARTS, strict=True)]


def named(depth: Column, sums: list[Column]) -> Column:
    """The 128-bit name of a node."""
    return F.struct(F.xxhash64(F.lit(3), depth, *sums).alias("a"), F.xxhash64(F.lit(4), depth, *sums).alias("b"))


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first, then role and text), parts of the turn, bytes of its text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), at.alias("at"), role.alias("role"), text.alias("text")
    )
    facts = [*parts("role", "text"), F.octet_length("text").cast("long").alias("bytes")]
    light = stored(turns.select("conv_id", "at", *facts))
    twice = light.groupBy("conv_id", "at").agg(F.count("*").alias("rows"), *[f(p).alias(f"{n}_{p}") for p in PARTS for n, f in (("l", F.min), ("h", F.max))])
    differ = reduce(lambda x, y: x | y, [F.col(f"l_{p}") != F.col(f"h_{p}") for p in PARTS])
    ties = stored(twice.where((F.col("rows") > 1) & differ).select("conv_id", "at"))
    once = light.withColumn("tie", F.lit(0).cast("long"))
    if not ties.isEmpty():
        told = ordered.running(turns.join(ties, ["conv_id", "at"], "left_semi"), ["conv_id", "at"], ["role", "text"], rank="tie")
        once = once.join(ties, ["conv_id", "at"], "left_anti").unionByName(told.select("conv_id", "at", *facts, "tie"))
    return ordered.running(once, ["conv_id"], ["at", "tie", *PARTS], rank="pos").select("conv_id", "pos", *PARTS, "bytes")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: the turns as (conv_id, pos, parts, bytes), and the conv_ids with their number of turns.

    Conversation c begins with the first h turns of c - c % family, then come its own turns after its first
    h, where h is crc32 of c in decimal modulo ``most``.
    """
    taken = lambda c: (F.crc32(c.cast("string").cast("binary")) % most).cast("long")
    turn = F.struct("pos", *PARTS, "bytes")
    convs = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") < most, turn))).alias("first")
    )
    convs = stored(convs.withColumn("h", taken(F.col("conv_id"))))
    givers = convs.select(F.col("conv_id").alias("giver"), F.col("first").alias("head"))
    heads = convs.drop("first").withColumn("giver", F.col("conv_id") - F.col("conv_id") % family).join(givers, "giver", "left")
    head = F.filter(F.coalesce("head", F.array().cast(givers.schema["head"].dataType)), lambda t: t["pos"] <= F.col("h"))
    heads = stored(heads.select("conv_id", "n", "h", head.alias("head")))
    given = heads.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    # Without a cut or a shift nothing of the other table is needed.
    shift = (F.size("head") - F.col("h")).cast("long")
    own = lookup(turns.where(F.col("pos") > taken(F.col("conv_id"))), heads.select("conv_id", "n", shift.alias("shift")), "conv_id")
    own = own.withColumn("pos", F.col("pos") + F.col("shift")).drop("shift")
    length = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return own.unionByName(given), heads.select("conv_id", length.cast("long").alias("length"))


def nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie: (node, parent, depth, conv_id, n_convs, bytes), and for each conversation the node where it ends."""
    mixed = turns.select("conv_id", "pos", "bytes", *parts("pos", *PARTS))
    own = {f"o{p}": F.col(p) for p in PARTS}
    summed = ordered.running(mixed.withColumns(own).drop(*PARTS), ["conv_id"], ["pos"], sums={p: F.col(f"o{p}") for p in PARTS}, count="length")
    sums, before = [F.col(p) for p in PARTS], [F.col(p) - F.col(f"o{p}") for p in PARTS]
    prefixes = stored(
        summed.select("conv_id", F.col("pos").alias("depth"), "bytes", "length", named(F.col("pos"), sums).alias("node"), named(F.col("pos") - 1, before).alias("parent"))
    )
    inner = prefixes.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes")
    )
    top = named(F.lit(0).cast("long"), [F.lit(0).cast("long")] * len(PARTS))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(top.alias("node"), F.lit(None).cast(inner.schema["parent"].dataType).alias("parent"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"))
    ends = prefixes.where("depth = length").select("node", "conv_id")
    return inner.unionByName(root), ends.unionByName(convs.where("length = 0").select(top.alias("node"), "conv_id"))


def _bottoms(chain: DataFrame) -> DataFrame:
    """Pointer doubling: (id, bottom, steps, add...) for chain nodes (id, down, steps, add...).

    ``down`` is the next node; where it is no chain node it is the bottom. Rows that have reached it rest.
    """
    values = [c for c in chain.columns if c not in ("id", "down", "steps")]
    active, rested = stored(chain), []
    everyone = active
    while True:
        onward = everyone.select(F.col("id").alias("down"), F.col("down").alias("next"), F.col("steps").alias("more"), *[F.col(v).alias(f"n_{v}") for v in values])
        met = stored(active.join(onward, "down", "left"))
        rested.append(met.where("next is null").select("id", "down", "steps", *values))
        active = met.where("next is not null").select("id", F.col("next").alias("down"), (F.col("steps") + F.col("more")).alias("steps"), *[(F.col(v) + F.col(f"n_{v}")).alias(v) for v in values])
        everyone = reduce(DataFrame.unionByName, rested, active)
        if active.isEmpty():
            return reduce(DataFrame.unionByName, rested)


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, n_leaves, values...) summed over each subtree of ``tree(id, parent, values...)``; roots have a null parent.

    The rows must be a forest: every parent is a row, no node is its own ancestor. Null ids take no part.
    """
    totals = ["n_leaves", *values]
    add = lambda names, *of: {n: reduce(lambda x, y: x + y, [F.coalesce(F.col(f"{o}{n}"), F.lit(0)) for o in of]) for n in names}
    zero = F.lit(0).cast("long")
    live = tree.where("id is not null").select("id", "parent", zero.alias("n_leaves"), *[F.col(v).cast("long").alias(v) for v in values], *[zero.alias(f"up_{v}") for v in totals])
    live = stored(live)
    raked, folded, first = [], [], True
    while not live.isEmpty():
        # Rake: nodes without children are finished and go into their parents.
        kids = live.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
        seen = live.join(kids, "id", "left")
        if first:  # later leaves have taken in all that was below them
            seen, first = seen.withColumn("n_leaves", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long")), False
        seen = stored(seen)
        leaves = seen.where("kids is null")
        raked.append(leaves.select("id", *totals))
        given = leaves.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("gone"), *[F.sum(F.col(v) + F.col(f"up_{v}")).alias(f"g_{v}") for v in totals])
        rest = seen.where("kids is not null").join(given, "id", "left").withColumns(add(totals, "", "g_"))
        rest = stored(rest.withColumn("kids", F.col("kids") - F.coalesce("gone", F.lit(0))).drop("gone", *[f"g_{v}" for v in totals]))
        # Compress: a node with one child passes on all it has to the lower end of its chain.
        only = rest.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.count("*").alias("n"), F.first("id").alias("down"), *[F.first(f"up_{v}").alias(f"d_{v}") for v in totals]
        )
        chain = rest.where("kids = 1").join(only.where("n = 1").drop("n"), "id")
        chain = chain.withColumns(add(totals, "", "d_")).withColumn("steps", F.lit(1).cast("long"))
        chain = stored(chain.select("id", "parent", "down", "steps", *totals, *[f"up_{v}" for v in totals]))
        if chain.isEmpty():
            live = rest.drop("kids")
            continue
        found = stored(_bottoms(chain.drop("parent", *[f"up_{v}" for v in totals])))
        folded.append((len(raked), found))
        upper = found.join(chain.select("id", "parent", *[f"up_{v}" for v in totals]), "id")
        upper = upper.groupBy(F.col("down").alias("id")).agg(
            F.max_by(F.struct("parent", *[(F.col(v) + F.col(f"up_{v}")).alias(f"up_{v}") for v in totals]), "steps").alias("top")
        )
        stay = rest.where("kids <> 1").drop("kids").join(upper, "id", "left")
        moved = {c: F.when(F.col("top").isNull(), F.col(c)).otherwise(F.col(f"top.{c}")) for c in ["parent", *[f"up_{v}" for v in totals]]}
        live = stored(stay.withColumns(moved).drop("top"))
    if not raked:
        return live.select("id", *totals)
    # Re-expand: what was folded in a phase needs the nodes that outlived it.
    known: DataFrame | None = None
    for phase in range(len(raked), 0, -1):
        for _, found in (x for x in folded if x[0] == phase):
            lower = known.select(F.col("id").alias("down"), *[F.col(v).alias(f"b_{v}") for v in totals])
            known = known.unionByName(stored(found.join(lower, "down").withColumns(add(totals, "", "b_")).select("id", *totals)))
        known = raked[phase - 1] if known is None else known.unionByName(raked[phase - 1])
    return known


def end_digests(ends: DataFrame, span: int = 4096) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are first joined within ranges of ``span`` numbers, so that a list has that many at most.
    """
    block = F.floor(F.col("conv_id") / span)
    lists = ends.groupBy("node", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    lists = stored(lists)
    counts = lists.groupBy("node").agg(F.count("*").alias("lists"), F.min("block").alias("first"), F.first("ids").alias("ids"))
    single = counts.where("lists = 1").select("node", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    several = counts.where("lists > 1").select("node", "first")
    if several.isEmpty():
        return single
    joined = F.concat(F.when(F.col("block") > F.col("first"), F.lit(",")).otherwise(F.lit("")), F.col("ids")).cast("binary")
    chained = lists.join(several, "node").select("node", "block", joined.alias("ends_sha256"))
    return single.unionByName(streamed_sha256(chained, "node", "block", ["ends_sha256"]))


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt``), one row per node.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes
    of the last text for every member but one, summed over the subtree), ends_sha256. Null role or text is empty; null
    turns come first; turns of equal number are ordered by role and text, equal rows count as often as they occur;
    rows without conv_id belong to no conversation. An empty table has no node, not even a root. Sequences are told by
    128-bit hashes: among n nodes two are mistaken for one with a probability of about n * n / 2**129.
    """
    turns, convs = rebuilt(placed(conversations))
    found, ends = nodes(turns, convs)
    found = stored(found)
    own = (F.col("n_convs") - 1) * F.col("bytes")
    sums = subtree_sums(found.select(F.col("node").alias("id"), "parent", own.alias("saved_tokens")), ["saved_tokens"])
    kids = found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    facts = found.join(kids, "node", "left").join(sums.withColumnRenamed("id", "node"), "node").join(end_digests(ends), "node", "left")
    facts = stored(facts.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    above = facts.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    return lookup(facts, above, "parent").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
