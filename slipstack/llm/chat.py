"""Chat formatting with Spark expressions only.

Turns of a conversation are put in order, adjacent turns of one role are merged into one block, and the
blocks are concatenated with the marks of a template:

    <|im_start|>role\\ntext<|im_sep|>next text of the same role<|im_end|>\\n

A text or role never holds a mark: every ``<|`` in it gets a backslash between its two characters, and what
looks like an escape gets one more, which is undone exactly. A line end in a role is written ``<|im_nl|>``.

Scale: a conversation is written in parts of bounded length (``PART`` characters and one text), so no task
gathers an unbounded one; usual conversations have one part. Where a turn stands is told by running values that cut large
conversations at their own order values; turns of a part are collected as structs, sorted and merged with
array functions. A block that goes on in the next part has its role in ``open_role`` there, so every part can be
read by itself and the parts joined in order are the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import stored, streamed_sha256
from slipstack.operators import ordered

START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|im_nl|>"
LEARNED = "assistant"
PART = 65_536
#: What a turn counts besides its text when parts are cut, so that many empty turns are cut as well.
MARKS = 32


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(LINE), F.lit("\n")))


def merged(turns: Column) -> Column:
    """Adjacent turns of one role as one block: array of (role, opens, texts)."""
    none = F.array().cast("array<struct<role:string,opens:boolean,texts:array<string>>>")
    block = lambda role, opens, texts: F.array(F.struct(role.alias("role"), opens.alias("opens"), texts.alias("texts")))

    def put(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        longer = F.concat(last["texts"], F.array(turn["text"]))
        grown = F.concat(F.slice(blocks, 1, F.size(blocks) - 1), block(last["role"], last["opens"], longer))
        opened = F.concat(blocks, block(turn["role"], turn["opens"], F.array(turn["text"])))
        return F.when(turn["opens"] | (F.size(blocks) == 0), opened).otherwise(grown)

    return F.aggregate(turns, none, put)


def pieces(blocks: Column, first: Column, last: Column) -> Column:
    """The written strings of a part in order, each with whether it is learned: array of (written, learned)."""
    piece = lambda written, learned: F.struct(written.alias("written"), learned.alias("learned"))
    no = F.lit(False)

    def write(block: Column, at: Column) -> Column:
        header = F.concat(F.when((at == 0) & first, F.lit("")).otherwise(F.lit(END)), F.lit(START), escaped_role(block["role"]), F.lit("\n"))
        learned = block["role"] == LEARNED
        texts = F.transform(
            block["texts"],
            lambda t, i: F.array(piece(F.when((i == 0) & block["opens"], header).otherwise(F.lit(SEP)), no), piece(escaped(t), learned)),
        )
        return F.flatten(texts)

    written = F.flatten(F.transform(blocks, write))
    return F.concat(written, F.when(last, F.array(piece(F.lit(END), no))).otherwise(F.array().cast("array<struct<written:string,learned:boolean>>")))


def spans(written: Column) -> Column:
    """The learned stretches of the joined pieces in characters: array of (start from 0, length)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        size = F.length(piece["written"])
        found = F.array(F.struct(state["at"].alias("start"), size.alias("length")))
        return F.struct((state["at"] + size).alias("at"), F.when(piece["learned"], F.concat(state["found"], found)).otherwise(state["found"]).alias("found"))

    return F.aggregate(written, start, step, lambda state: state["found"])


def formatted(conversations: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, parts_end, open_role, formatted, loss_spans), one row per part of a conversation.

    Turns go by their number, null first, then by role and text; repeated rows count as often as they occur. A null
    role or text is empty; rows without conv_id are a conversation of their own. ``parts_end`` marks the last part,
    ``open_role`` is the role of the block that a part goes on with (null if it begins with a new one), ``loss_spans``
    are the stretches of ``formatted`` with texts of the assistant. An empty table gives no rows.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = (F.length("text") + F.length("role") + MARKS).cast("long")
    told = ordered.running(
        turns, ["conv_id"], ["turn", "role", "text"], rank="pos", count="n", sums={"upto": size}, previous={"before": F.col("role")}
    )
    opens = F.col("before").isNull() | (F.col("before") != F.col("role"))
    turn = F.struct("pos", "role", "text", opens.alias("opens"))
    grouped = told.withColumn("part", F.floor((F.col("upto") - size) / part)).groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.max(F.col("pos") == F.col("n")).alias("parts_end")
    )
    opening = F.element_at("turns", 1)
    rows = grouped.select(
        "conv_id",
        "part",
        "parts_end",
        F.when(~opening["opens"], opening["role"]).alias("open_role"),
        pieces(merged(F.col("turns")), opening["pos"] == 1, F.col("parts_end")).alias("pieces"),
    )
    return rows.select(
        "conv_id", "part", "parts_end", "open_role",
        F.array_join(F.transform("pieces", lambda p: p["written"]), "").alias("formatted"),
        spans(F.col("pieces")).alias("loss_spans"),
    )


def read_back(parts: DataFrame) -> DataFrame:
    """``parts`` with ``turns`` (array of role, text) and ``learned`` (array of texts), both taken from ``formatted``."""
    header = F.concat(F.lit(START), escaped_role(F.col("open_role")), F.lit("\n"))
    whole = F.when(F.col("open_role").isNotNull(), F.concat(header, F.expr(f"substring(formatted, {len(SEP) + 1})"))).otherwise(F.col("formatted"))

    def block(written: Column) -> Column:
        role = unescaped_role(F.substring_index(written, "\n", 1))
        body = F.substring_index(F.substring(written, F.instr(written, "\n") + 1, F.length(written)), END, 1)
        return F.transform(F.split(body, r"\Q" + SEP + r"\E", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.split(whole, r"\Q" + START + r"\E", -1)
    turns = F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), block))
    learned = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return parts.withColumns({"turns": turns, "learned": learned})


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the parts.

    The digest of a conversation of one part is taken where it stands; only those of several parts are chained.
    """
    back = read_back(parts)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary")
    loss = F.array_join("learned", "")
    lengths = {"n_turns": F.size("turns"), "loss_chars": F.length(loss), "formatted_chars": F.length("formatted")}
    facts = stored(
        back.select("conv_id", "part", (F.col("parts_end") & (F.col("part") == 0)).alias("single"), turns.alias("turns_sha256"),
                    loss.cast("binary").alias("loss_sha256"), *[c.cast("long").alias(n) for n, c in lengths.items()])
    )
    values = ["turns_sha256", "loss_sha256"]
    single = facts.where("single").select("conv_id", *lengths, *[F.sha2(v, 256).alias(v) for v in values])
    several = facts.where("not single")
    chained = streamed_sha256(several, "conv_id", "part", values).withColumnsRenamed({v: f"s_{v}" for v in values})
    totals = several.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in lengths])
    both = totals.join(chained.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    return single.unionByName(both.select("conv_id", *lengths, *[F.col(f"s_{v}").alias(v) for v in values]))
