"""Language-model scoring with a subword lattice.

A text is an exchangeable sequence of words and one end. Word probabilities come from the training
counts by absolute discounting; the mass taken off goes to a distribution over all byte strings: the
lattice of every segmentation of the word into pieces of an existing vocabulary, weighted by the
scores of that vocabulary and summed by a forward recursion in log space. Probabilities stay logarithms
to the end, so words of any length are told apart. Within a text the words
already seen gain weight (Dirichlet-multinomial with ``memory`` pseudo-tokens), so the probability of
a text depends only on how often each word occurs in it.

Scale: words that make up at least ``head`` of all tokens, thus 1/head at most, are known to every
task; the rest meet their probability in one shuffle join on the word. None of them can be frequent,
so no key of that join is hot. Nothing else than the head leaves the executors. The driver reads the
vocabulary and sends its weights to the tasks, which need no file of their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import remainder, stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD = 1e-6
MEMORY = 1000.0
STOP = 0.25
RANK_SHIFT = 2.7
BYTE_SHARE = 0.05
FLUSH = 200_000
END = b" end"  # no word holds a space


def scores_of(path: str = VOCABULARY) -> dict[bytes, float]:
    """The pieces of a vocabulary file and their weights.

    The file scores a piece by its negated rank: merges first, then the alphabet, both from the most
    frequent on. Rank r of either list weighs 1 / (r + RANK_SHIFT), the fall of frequencies over ranks
    that Zipf and Mandelbrot found.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = {i: (len(model.id_to_piece(i)) == 1, model.get_score(i)) for i in ids}
    first = {letter: max(s for x, s in ranked.values() if x == letter) for letter in {x for x, _ in ranked.values()}}
    return {model.id_to_piece(i).encode(): 1.0 / (RANK_SHIFT + first[letter] - score) for i, (letter, score) in ranked.items()}


class Lattice:
    """All segmentations of a word into weighted pieces, over bytes; single bytes always fit.

    Together with the share of the single bytes and of the stop after each piece the weights sum to one.
    """

    def __init__(self, weights: dict[bytes, float]):
        total = sum(weights.values()) or 1.0
        self.pieces = {k: math.log((1 - STOP) * (1 - BYTE_SHARE) * v / total) for k, v in weights.items()}
        self.single = math.log((1 - STOP) * BYTE_SHARE / 256)
        by_first: dict[int, set[int]] = {}
        for piece in weights:
            by_first.setdefault(piece[0], set()).add(len(piece))
        self.lengths = [sorted(by_first.get(b, ())) for b in range(256)]
        self.nothing = math.log(1 - STOP)

    def log_prob(self, word: bytes) -> float:
        """Natural log of the probability of the word, over all segmentations of "▁" + word."""
        text = b"\xe2\x96\x81" + word
        n = len(text)
        low = -1e300
        forward = [low] * (n + 1)
        forward[0] = 0.0
        get, single, lengths = self.pieces.get, self.single, self.lengths
        exp, log1p = math.exp, math.log1p
        for i in range(n):
            here = forward[i]
            value, there = here + single, forward[i + 1]
            if there == low:
                forward[i + 1] = value
            elif there >= value:
                forward[i + 1] = there + log1p(exp(value - there))
            else:
                forward[i + 1] = value + log1p(exp(there - value))
            for m in lengths[text[i]]:
                j = i + m
                if j > n:
                    break
                score = get(text[i:j])
                if score is None:
                    continue
                value, there = here + score, forward[j]
                if there == low:
                    forward[j] = value
                elif there >= value:
                    forward[j] = there + log1p(exp(value - there))
                else:
                    forward[j] = value + log1p(exp(there - value))
        return forward[n] + math.log(STOP) - self.nothing


def grown(log_weight: Column, times: Column) -> Column:
    """log10 of w * (w + 1) * ... with ``times`` factors, for w = 10 ** log_weight, however small w is.

    The first factor is the logarithm itself, the next ones are added up; from the sixteenth on the
    difference of two logarithms of the gamma function stands for them (Stirling's series, exact to 1e-11).
    """
    weight = F.pow(F.lit(10.0), log_weight)
    some = F.aggregate(F.sequence(F.lit(1), F.least(times, F.lit(16)).cast("int") - 1), F.lit(0.0), lambda s, j: s + F.log10(weight + j))

    def gamma(x: Column) -> Column:
        return (x - 0.5) * F.log(x) - x + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)

    more = (gamma(weight + times) - gamma(weight + 16)) / math.log(10)
    return log_weight + F.when(times > 1, some).otherwise(0.0) + F.when(times > 16, more).otherwise(0.0)


def rising(log_weight: float, times: int) -> float:
    """``grown`` as a plain function."""
    if times == 1:
        return log_weight
    weight = 10.0**log_weight
    if times < 20:
        return log_weight + sum(math.log10(weight + j) for j in range(1, times))
    return log_weight + (math.lgamma(weight + times) - math.lgamma(weight + 1)) / math.log(10)


def log_sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    low, high = min(a, b), max(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of every word and of the end in training rows, 0 if only held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        other: set[bytes] = set()

        def out():
            other.difference_update(seen)
            keys = [*seen, *other]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([*seen.values(), *[0] * len(other)], pa.int64())], ["word", "c"]
            )

        for batch in batches:
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = text.lower().split()
                if train:
                    seen.update(found)
                    seen[END] += 1
                else:
                    other.update(found)
                    other.add(END)
                if len(seen) + len(other) > FLUSH:
                    yield out()
                    seen.clear()
                    other.clear()
        yield out()

    return docs.select("text", "train").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, vocabulary: str = VOCABULARY, memory: float = MEMORY, head: float = HEAD) -> DataFrame:
    """Score every row of ``docs(doc_id, text, held_out)``; rows not held out are the training text.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input
    row, also for repeated or null ids. A null text is empty: it has its end only. Without training
    text every token is unknown. Other columns of the input play no part.
    """
    read = docs.select(
        "doc_id",
        "held_out",
        F.monotonically_increasing_id().alias("key"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    vocab = stored(count_words(read.select("text", (~F.col("held_out")).alias("train"))))
    facts = vocab.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count(F.when(F.col("c") > 0, 1)).alias("v"),
        F.count(F.when(F.col("c") == 1, 1)).alias("n1"),
        F.count(F.when(F.col("c") == 2, 1)).alias("n2"),
    ).first()
    n, v = facts["n"], facts["v"]
    discount = facts["n1"] / (facts["n1"] + 2 * facts["n2"]) if facts["n1"] and facts["n2"] else 0.5
    spare = discount * v / n if n else 1.0
    end_share = 1.0 / (v + 1) if v else 0.5

    sent = docs.sparkSession.sparkContext.broadcast(scores_of(vocabulary))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log_weight: log10 of memory times the probability of the word."""
        lattice = Lattice(sent.value)
        for batch in batches:
            keys, counts = batch.column(0), batch.column(1).to_pylist()
            out = []
            for word, c in zip(keys.to_pylist(), counts, strict=True):
                spelled = math.log(spare) + (math.log(end_share) if word == END else math.log1p(-end_share) + lattice.log_prob(word))
                seen = math.log((c - discount) / n) if c else -math.inf
                out.append((math.log(memory) + log_sum(seen, spelled)) / math.log(10))
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array(out, pa.float64())], ["word", "c", "log_weight"])

    weighed = "word binary, c long, log_weight double"
    least = max(1.0, head * n)  # at most 1 / head words
    top = {r["word"]: (r["c"], r["log_weight"]) for r in vocab.where(F.col("c") >= least).mapInArrow(weigh, weighed).toLocalIterator()}
    top = {bytes(k): x for k, x in top.items()}
    known_words = docs.sparkSession.sparkContext.broadcast(top)
    total = n + v + 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with the head words summed, and a row for each other word of it."""
        heads = known_words.value
        log10, total_log = math.log10, math.log10(total)
        fields = ["key", "word", "times", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        rows: list[list] = [[] for _ in fields]

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], fields)
            for x in rows:
                x.clear()
            return batch

        for batch in batches:
            for key, doc_id, held, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                counts = Counter(text.lower().split())
                size = sum(counts.values()) + 1
                counts[END] = 1
                known, base, value = 0, -size * total_log, -rising(math.log10(memory), size)
                tail = []
                for word, times in counts.items():
                    found = heads.get(word)
                    if found is None:
                        tail.append((word, times))
                        continue
                    known += times
                    base += times * log10(found[0] + 1)
                    value += rising(found[1], times)
                for word, times in ((b" %d" % key, 0), *tail):
                    first = not times
                    for x, cell in zip(rows, (key, word, times, doc_id if first else None, held if first else None, size if first else 0, known if first else 0, base if first else 0.0, value if first else 0.0), strict=True):
                        x.append(cell)
                if len(rows[0]) > FLUSH:
                    yield out()
        yield out()

    emitted = read.select("key", "doc_id", "held_out", "text").mapInArrow(
        split,
        "key long, word binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    rare = vocab.where(F.col("c") < least).mapInArrow(weigh, weighed)
    times = F.col("times")
    real = times > 0
    joined = emitted.join(rare, "word", "left").select(
        "key",
        "doc_id",
        "held_out",
        "n_tokens",
        F.when(real & (F.col("c") > 0), times).otherwise(F.col("n_known")).alias("n_known"),
        F.when(real, times * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)).otherwise(F.col("base_score")).alias("base_score"),
        F.when(real, grown(F.col("log_weight"), times)).otherwise(F.col("score")).alias("score"),
    )
    return (
        joined.groupBy("key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            F.sum("base_score").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("key")
    )


def with_held_out(docs: DataFrame, by: int = 7, part: int = 2) -> DataFrame:
    return docs.select("doc_id", "text", (remainder(F.col("doc_id"), by) == part).alias("held_out"))
