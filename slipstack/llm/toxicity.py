"""Toxicity by a learned lexicon, misspellings and context.

Learning: words that toxic training texts share and clean ones avoid become the lexicon. Scoring: the
words of a text meet the lexicon through its trie, walked together with a Levenshtein automaton, so
that misspelled terms are caught. Every hit is judged by its window: other hits and words of address
close by speak for abuse, quotation marks around it and words of report for quotation. A logistic
regression on few such facts, fitted on the training labels, gives the score.

Scale: only ids, hashes and word counts of labelled training texts are shuffled. A lexicon term stands in a fixed share
of the toxic texts at least, so there are no more terms than the mean number of words of a text divided
by that share, whatever the corpus; this is what every task gets. Scoring is a map over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import remainder, stored

LEAST_SHARE = 0.004  # of the toxic training texts that hold a term
LEAST_TEXTS = 5
LEAST_ODDS = math.log(8)  # log odds against the share among clean texts
LONGEST_TERM = 40
FUZZY_FROM = 5  # shorter words are matched exactly only
WINDOW = 6
FIT_ROWS = 200_000
MOST_BROADCAST = 2_000_000
FLUSH = 200_000
RIDGE = 1e-2
STEPS = 25
THRESHOLD = 0.3

#: Words of report and of address around a term, in the languages of the corpus.
REPORT = frozenset(
    "said says wrote writes called calls quoted quote quotes word term phrase dit écrit mot appelé dijo escribió palabra llamó sagte schrieb wort nannte".split()
)
ADDRESS = frozenset("you your you're ur yourself du dich dir tu te toi vous ton tú usted eres".split())
QUOTES = frozenset("\"“”„«»‘’'")
SIGNS = ".,:;!?()[]{}<>*_~#|/…" + "".join(sorted(QUOTES))
TOKEN = re.compile(r"[^\W_]+")
FACTS = ("bias", "weight", "peak", "fuzzy", "quoted", "density", "hits")


class FuzzyTrie:
    """A trie of terms, walked by a Levenshtein automaton of distance one.

    A state is the set of (trie node, edits spent) that the letters read so far can have reached; the
    transitions that occur are kept, so that a letter mostly costs one look-up. Terms shorter than
    ``fuzzy_from`` are matched exactly.
    """

    def __init__(self, terms: list[str], fuzzy_from: int = FUZZY_FROM, most_states: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in sorted(terms):
            node = 0
            for c in term:
                following = self.children[node].get(c)
                if following is None:
                    following = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = following
            self.term[node] = term
        self.fuzzy_from, self.most_states = fuzzy_from, most_states
        self._restart()

    def _restart(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, reached: set[tuple[int, int]]) -> int:
        """Number of the state, closed under skipping a letter of a term; -1 for the empty one."""
        whole = set(reached)
        for node, spent in reached:
            if spent == 0:
                whole.update((child, 1) for child in self.children[node].values())
        whole = frozenset((n, s) for n, s in whole if not (s == 1 and (n, 0) in whole))
        if not whole:
            return -1
        found = self.known.get(whole)
        if found is None:
            found = self.known[whole] = len(self.states)
            self.states.append(whole)
            self.moves.append({})
        return found

    def _move(self, state: int, c: str) -> int:
        reached = set()
        for node, spent in self.states[state]:
            child = self.children[node].get(c)
            if child is not None:
                reached.add((child, spent))
            if spent == 0:
                reached.add((node, 1))  # a letter too many
                reached.update((x, 1) for k, x in self.children[node].items() if k != c)  # another letter
        following = self.moves[state][c] = self._state(reached)
        return following

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within one edit; ties by the term's text."""
        if len(self.states) > self.most_states:
            self._restart()
        state = self.start
        for c in word:
            following = self.moves[state].get(c)
            if following is None:
                following = self._move(state, c)
            if following < 0:
                return None
            state = following
        best = None
        for node, spent in self.states[state]:
            term = self.term[node]
            if term is None or (spent and min(len(term), len(word)) < self.fuzzy_from):
                continue
            if best is None or (spent, term) < best:
                best = (spent, term)
        return (best[1], best[0]) if best else None


def plain(word: str) -> str:
    """Lower case; digits and signs that stand for letters are read as these."""
    return word.lower().translate(LOOKALIKES)


LOOKALIKES = str.maketrans("013457@$", "oieastas")


class Scorer:
    """Facts of a text from the lexicon (term -> log odds) and clean words that resemble its terms."""

    def __init__(self, lexicon: dict[str, float], clean: frozenset[str], bound: int = 300_000):
        self.lexicon, self.clean, self.bound = lexicon, clean, bound
        self.trie = FuzzyTrie(list(lexicon))
        self.seen: dict[str, tuple[float, int]] = {}

    def weight(self, word: str) -> tuple[float, int]:
        """(weight, 1 if misspelled); (0, 0) for other words."""
        found = self.seen.get(word)
        if found is None:
            found = (0.0, 0)
            exact = self.lexicon.get(word)
            if exact is not None:
                found = (exact, 0)
            elif word not in self.clean and len(word) <= LONGEST_TERM + 1:
                match = self.trie.match(word)
                if match is None and (read := plain(word)) != word:
                    match = (read, 1) if read in self.lexicon else None
                if match is not None:
                    found = (self.lexicon[match[0]], 1)
            if len(self.seen) >= self.bound:
                self.seen.clear()
            self.seen[word] = found
        return found

    def facts(self, text: str) -> list[float]:
        weight, seen = self.weight, self.seen
        tokens = text.lower().split()
        hits = []
        for i, token in enumerate(tokens):
            found = seen.get(token)
            if found is None:
                # Signs around a token are left out; with signs inside, its words and the whole are tried.
                core = token.strip(SIGNS)
                found = weight(core)
                if not found[0] and not core.isalnum():
                    found = max((weight(x) for x in TOKEN.findall(core)), default=(0.0, 0))
                seen[token] = found
            if found[0]:
                hits.append((i, *found))
        if not hits:
            return [1.0, 0, 0, 0, 0, 0, 0]
        peak = fuzzy = quoted = total = 0.0
        low = high = 0
        for k, (at, value, misspelled) in enumerate(hits):
            while hits[low][0] < at - WINDOW:
                low += 1
            while high < len(hits) and hits[high][0] <= at + WINDOW:
                high += 1
            near = tokens[max(0, at - WINDOW) : at + WINDOW + 1]
            here = at - max(0, at - WINDOW)
            before, after = near[:here], near[here + 1 :]
            marks = any(not QUOTES.isdisjoint(x[:1] + x[-1:]) for x in (*before, near[here][:1])) and any(not QUOTES.isdisjoint(x[:1] + x[-1:]) for x in (near[here][-1:], *after))
            report = sum(x.strip('.,:;!?"') in REPORT for x in before)
            others = sum(hits[j][1] for j in range(low, high) if j != k)
            abuse = value + 0.5 * others + sum(x.strip('.,:;!?"') in ADDRESS for x in near)
            quoting = 2.0 * marks + 1.0 * (report > 0)
            score = abuse - quoting
            peak = max(peak, score)
            total += value
            if misspelled:
                fuzzy += 1
            if marks or report:
                quoted += 1
        n = len(hits)
        return [1.0, math.log1p(total), peak, fuzzy / n, quoted / n, n / (len(tokens) + 5), math.log1p(n)]


def attach(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Inner join with a table that is broadcast if it was counted and found small, else shuffled."""
    return rows.join(F.broadcast(more) if more.count() <= MOST_BROADCAST else more, key)


def training_texts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of distinct labelled training texts.

    Copies are told by a hash and settled on slim rows, so texts are not shuffled while the labels can
    be broadcast: a text stands with its smallest id, and is toxic if any copy is.
    """
    known = stored(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    open_rows = rows.where(~F.col("held_out"))
    slim = attach(open_rows.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("copy")), known, "doc_id")
    chosen = stored(slim.groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    return attach(open_rows, chosen, "doc_id").select("text", "toxic")


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], frozenset[str]]:
    """Lexicon and look-alikes from ``train(text, toxic)``.

    A term stands in LEAST_SHARE of the toxic texts (LEAST_TEXTS at least) and is LEAST_ODDS likelier
    there than in clean ones. Clean words within one edit of a term are no misspellings; they are found
    by the same automaton over the counted words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, bad, n) of a task, emptied into rows whenever it has grown."""
        bad, every = Counter(), Counter()

        def out():
            keys = list(every)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([every[k] for k in keys], pa.int64())], ["word", "bad", "n"]
            )
            bad.clear()
            every.clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {x.strip(SIGNS) for x in set(text.lower().split())}
                every.update(found)
                if toxic:
                    bad.update(found)
                if len(every) > FLUSH:
                    yield out()
        yield out()

    counts = train.select("text", "toxic").mapInArrow(count, "word string, bad long, n long")
    counted = stored(
        counts.where((F.length("word") >= 3) & (F.length("word") <= LONGEST_TERM)).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    )
    sizes = train.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = sizes["bad"] or 0, (sizes["n"] or 0) - (sizes["bad"] or 0)
    least = max(LEAST_TEXTS, LEAST_SHARE * bad)
    among_bad, among_good = (F.col("bad") + 0.5) / F.lit(bad + 1.0), (F.col("n") - F.col("bad") + 0.5) / F.lit(good + 1.0)
    terms = counted.where(F.col("bad") >= least).withColumn("odds", F.log(among_bad / among_good)).where(F.col("odds") >= LEAST_ODDS)
    lexicon = {r["word"]: r["odds"] for r in terms.select("word", "odds").collect()}
    if not lexicon:
        return {}, frozenset()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FuzzyTrie(list(lexicon))
        for batch in batches:
            found = [w for w in batch.column(0).to_pylist() if w not in lexicon and trie.match(w) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

    # Words one edit away from a term: their number is bounded by the letters of the lexicon.
    ordinary = counted.where((F.col("n") > F.col("bad")) & (among_bad <= 2.0 * among_good))
    clean = {r[0] for r in ordinary.select("word").mapInArrow(alike, "word string").collect()}
    return lexicon, frozenset(clean)


def fit(facts: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps, with a small ridge."""
    beta = np.zeros(facts.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(facts @ beta, -30, 30)))
        slope = facts.T @ (labels - p) - RIDGE * beta
        curve = (facts * (p * (1 - p))[:, None]).T @ facts + RIDGE * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


JUDGED = "held_out boolean, score double, predicted int"


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Struct ``row`` with all columns of ``docs(doc_id, text)``, and held_out, score, predicted.

    ``labels(doc_id, toxic)``: rows that are null, held out or without document teach nothing; of
    several labels of a document the largest counts. Counts of words cover all labelled training texts;
    the regression is fitted on about ``fit_rows`` of them at most, chosen by the hash of their text.
    Texts without any hit, empty and null ones too, get the share that such texts have in training.
    Without usable labels the score is 0. One row per input row.
    """
    spark = docs.sparkSession
    held = remainder(F.col("doc_id"), 4) == 2
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, "doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    train = training_texts(rows, labels)
    lexicon, clean = learn_lexicon(train)
    sent = spark.sparkContext.broadcast((lexicon, clean))
    made: dict[int, Scorer] = {}

    def scorer() -> Scorer:
        if not made:
            made[0] = Scorer(*sent.value)
        return made[0]

    def take_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([scorer().facts(x) for x in batch.column(0).to_pylist()], dtype=float).reshape(-1, len(FACTS))
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(len(FACTS))), batch.column(1)], [*FACTS, "toxic"])

    schema = ", ".join(f"{x} double" for x in FACTS) + ", toxic int"
    total = train.count()
    share = min(1.0, fit_rows / max(1, total))
    chosen = train.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    sample = chosen.select("text", "toxic").mapInArrow(take_facts, schema).toPandas()
    seen = sample["toxic"].to_numpy(float)
    if not len(seen):
        beta = [-100.0] + [0.0] * (len(FACTS) - 1)
    else:
        beta = fit(sample[list(FACTS)].to_numpy(float), seen)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([scorer().facts(x) for x in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FACTS))
            p = 1 / (1 + np.exp(-np.clip(found @ np.array(beta), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["row", "held_out", "score", "predicted"]
            )

    kind = docs.schema.simpleString()
    return rows.select("row", "text", "held_out").mapInArrow(judge, f"row {kind}, {JUDGED}")


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; see ``judged``."""
    return judged(docs.select("doc_id", "text"), labels, threshold).select("row.doc_id", "held_out", "score", "predicted")
