"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its five-word shingles. Its sketch has T coordinates, filled in rounds: in
round i every shingle is thrown into one bin by hash i, and a bin keeps the least (round, value) it
saw; from round T on, round T + j throws all shingles into bin j. So every bin fills, two sketches
agree in a bin with the probability of their Jaccard similarity, and the number of agreeing bins is
concentrated as with independent samples, at about one hash per shingle for large sets.

Equal sets are one class. Classes that share all coordinates of a band meet in a bucket. Buckets are
not turned into pairs. First every member is compared with the least member of its bucket, which joins
nearly all that belong together. Buckets that share members and still hold several components are then
searched inside tasks, in blocks: sketches first, then full sets, and only pairs not yet joined. What
leaves a task are the links that join, never all pairs.

Scale: rows that are shuffled are ids and hashes; texts move only for classes that share a bucket, and
a task holds two blocks at most. Large classes and buckets are only aggregated or met through salted
look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import WordHashes, components, lookup, mixed, stored

WIDTH = 5
BANDS = 25
ROWS = 5
BINS = BANDS * ROWS
NUMERATOR, DENOMINATOR = 85, 100
#: Deviations below the expected number of equal bins from which sketches are not compared in full.
DEVIATIONS = 7
GROUP = 500
WHOLE_GROUP = 20_000
AT_ONCE = 1_500_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLDEN = 0x9E3779B97F4A7C15


def least_agreeing(percent: int) -> int:
    """Equal bins that two sketches need to be compared in full: 78 of 125 at a similarity of 85 %, 68 at 80 %."""
    share = percent / DENOMINATOR
    return int(BINS * share - DEVIATIONS * (BINS * share * (1 - share)) ** 0.5)


def rows_of(percent: int) -> int:
    """Bins in a band: five at 85 % and more, four below, so that all bands miss a pair at the limit with less than 1e-6."""
    return ROWS if percent >= NUMERATOR else ROWS - 1


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle make one together."""
    n = len(hashes)
    if not n:
        return hashes
    span = min(width, n)
    total = np.full(n - span + 1, span, np.uint64)
    for j in range(span):
        total += mixed(hashes[j : n - span + 1 + j] + np.uint64((j + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF))
    return np.unique(mixed(total))


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Sketches (sets x bins, uint64) of non-empty sets of hashes, all at once."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.full((len(sets), bins), EMPTY, np.uint64)
    flat = out.reshape(-1)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    for i in range(2 * bins):
        if not len(values):
            break
        h = mixed(values ^ mixed(np.array([i * GOLDEN & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        # Round in the top bits, so that an earlier round always wins; bin and value from other bits.
        value = (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10))
        if i < bins:
            place = owner * bins + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            place = owner * bins + (i - bins)
        np.minimum.at(flat, place, value)
        open_sets = (out == EMPTY).any(axis=1)
        if i + 1 < 2 * bins:
            keep = open_sets[owner]
            values, owner = values[keep], owner[keep]
    return out


FEATURES = "doc_id long, n_shingles long, same binary, sketch binary"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, same (hash of the set, null if empty), sketch (low 32 bits of each bin)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at, pending, waiting = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                pending.append(shingles(words.of(text.as_py().lower().split())))
                waiting += len(pending[-1])
                if waiting < AT_ONCE and i + 1 < len(ids):
                    continue
                full = [x for x in pending if len(x)]
                drawn = iter(mixed(sketches(full)).astype(np.uint32))
                sketch = [next(drawn).tobytes() if len(x) else None for x in pending]
                same = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in pending]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : i + 1], pa.int64()),
                        pa.array([len(x) for x in pending], pa.int64()),
                        pa.array(same, pa.binary()),
                        pa.array(sketch, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "same", "sketch"],
                )
                at, pending, waiting = i + 1, [], 0

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select("doc_id", text).mapInArrow(make, FEATURES)


def bands(classes: DataFrame, rows: int = ROWS) -> DataFrame:
    """(band, rep): a row for each band of each class; band hashes its number and coordinates."""
    n = BINS // rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed((np.arange(BINS, dtype=np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BINS).astype(np.uint64)
            keys = mixed(mixed(found ^ salt)[:, : n * rows].reshape(-1, n, rows).sum(axis=2, dtype=np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n))], ["band", "rep"]
            )

    return classes.select("rep", "sketch").mapInArrow(cut, "band long, rep long")


def verified(pairs: DataFrame, sketches_of: DataFrame, texts: DataFrame, percent: int = NUMERATOR) -> DataFrame:
    """Those (a, b) of distinct pairs whose full sets reach the similarity."""
    least = least_agreeing(percent)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, BINS)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, BINS)
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, centre = WordHashes(), None, None
        for batch in batches:
            a, b = [], []
            for i, (one, two) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if one != last:
                    last, centre = one, shingles(words.of(batch.column(2)[i].as_py().lower().split()))
                other = shingles(words.of(batch.column(3)[i].as_py().lower().split()))
                if same_set(centre, other, percent):
                    a.append(one)
                    b.append(two)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    left = sketches_of.select(F.col("rep").alias("a"), F.col("sketch").alias("x"))
    right = sketches_of.select(F.col("rep").alias("b"), F.col("sketch").alias("y"))
    near = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")
    ta = texts.select(F.col("rep").alias("a"), F.col("text").alias("s"))
    tb = texts.select(F.col("rep").alias("b"), F.col("text").alias("t"))
    return near.join(tb, "b").join(ta, "a").select("a", "b", "s", "t").mapInArrow(compare, "a long, b long")


def same_set(one: np.ndarray, two: np.ndarray, percent: int = NUMERATOR) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = sorted((one, two), key=len)
    if DENOMINATOR * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return DENOMINATOR * shared >= percent * (len(small) + len(large) - shared)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of incidence matrices."""
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, number, counts = np.unique(values, return_inverse=True, return_counts=True)
    # Shingles of a single set add nothing.
    fresh = np.cumsum(counts > 1) - 1
    owner, number = owner[counts[number] > 1], fresh[number[counts[number] > 1]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((len(left), len(right)), np.float32)  # exact below 2**24
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        low, high = np.searchsorted(number, [start, start + columns])
        part = np.zeros((len(left) + len(right), columns), np.float32)
        part[owner[low:high], number[low:high] - start] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def joined(
    members: list[tuple[int, int, np.ndarray, bytes]], across: int, words: WordHashes, percent: int = NUMERATOR
) -> list[tuple[int, int]]:
    """Links that join members (id, component, sketch, text) which are still apart.

    Compares all pairs, or those of the first ``across`` members with the others if that is not zero.
    Of the links between two components one is given.
    """
    drawn = np.stack([m[2] for m in members])
    kind = np.array([m[1] for m in members])
    left = np.arange(across or len(members))
    right = np.arange(across, len(members))
    close, least = np.zeros((len(left), len(right)), bool), least_agreeing(percent)
    for i in left:
        close[i] = ((drawn[right] == drawn[i]).sum(axis=1) >= least) & (kind[right] != kind[i])
        if not across:
            close[i, : i + 1] = False
    rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(rows):
        return []
    made: dict[int, np.ndarray] = {}
    for k in {*left[rows].tolist(), *right[columns].tolist()}:
        made[k] = shingles(words.of(members[k][3].lower().split()))
    one, two = [made[k] for k in left[rows].tolist()], [made[k] for k in right[columns].tolist()]
    shared = shared_counts(one, two)
    either = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None, :] - shared
    linked = close[np.ix_(rows, columns)] & (DENOMINATOR * shared >= percent * either)
    root = {c: c for c in kind.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, k in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        x, y = int(left[rows[i]]), int(right[columns[k]])
        a, b = find(int(kind[x])), find(int(kind[y]))
        if a != b:
            root[a] = b
            out.append((members[x][0], members[y][0]))
    return out


def remaining_links(members: DataFrame, percent: int, block: int = GROUP) -> DataFrame:
    """Links (a, b) between different components of a group, for ``members(group, n, rep, component, sketch, text)``.

    Groups are cut into blocks, and each pair of blocks is one task's work; only links leave it.
    """
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    own = members.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select(
        "group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "component", "sketch", "text"
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, waiting = WordHashes(), None, []

        def out():
            split = sum(w[0] == last[1] for w in waiting) if last[1] != last[2] else 0
            found = joined([w[1:] for w in waiting], split, words, percent) if len(waiting) > 1 and split < len(waiting) else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *key, block_no, rep, component, sketch, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and waiting:
                    yield out()
                    waiting = []
                last = key
                waiting.append((block_no, rep, component, np.frombuffer(sketch, np.uint32), text))
        if waiting:
            yield out()

    order = ["group", "low", "high", "block"]
    return dealt.repartition("group", "low", "high").sortWithinPartitions(*order).mapInArrow(solve, "a long, b long")


def links(classes: DataFrame, texts: DataFrame, ties: DataFrame, percent: int = NUMERATOR) -> DataFrame:
    """(node, component) of the classes that have any link or tie; others are missing."""
    members = bands(classes, rows_of(percent))
    sizes = stored(members.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1"))
    buckets = stored(lookup(members, sizes, "band", how="inner"))
    # Every member against the least of its bucket: this settles nearly all.
    pairs = stored(buckets.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())
    groups = stored(components(pairs))
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    wanted = groups.select(F.col("node").alias("rep"), F.col("component").alias("group"))
    chosen = stored(texts.join(wanted, "rep"))
    sketches_of = stored(classes.select("rep", "sketch").join(wanted.select("rep"), "rep", "left_semi"))
    edges = stored(verified(pairs, sketches_of, chosen, percent).unionByName(ties))
    roots = stored(components(edges))
    # Groups of buckets that share members and are still in several components.
    placed = chosen.join(roots, chosen["rep"] == roots["node"], "left").select("group", "rep", "text", F.coalesce("component", "rep").alias("component"))
    apart = stored(
        placed.groupBy("group").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("group", "n")
    )
    if apart.isEmpty():
        return roots
    placed = lookup(placed, apart.select("group", "n", F.col("n").alias("members")), "group", how="inner")
    whole = placed.where(F.col("members") <= WHOLE_GROUP).join(sketches_of, "rep").withColumnRenamed("members", "n")
    more = remaining_links(whole, percent)
    if not apart.where(F.col("n") > WHOLE_GROUP).isEmpty():
        # Long chains of buckets: bucket by bucket.
        parts = placed.where(F.col("members") > WHOLE_GROUP).select("rep", "component", "text").join(buckets.select("rep", "band"), "rep")
        parts = lookup(parts, sizes.select("band", "n", F.col("n").alias("members")), "band", how="inner")
        parts = parts.select(F.col("band").alias("group"), F.col("members").alias("n"), "rep", "component", "text").join(sketches_of, "rep")
        more = more.unionByName(remaining_links(parts, percent))
    return stored(components(edges.unionByName(more)))


def near_duplicates(docs: DataFrame, percent: int = NUMERATOR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``.

    Two documents are linked when 100 * shared >= ``percent`` * all shingles. Null and empty texts have no
    shingles and no links. Rows that repeat an id are one document, whose links are joined. A null id
    has no component and is kept. Texts whose sets are equal are linked whatever their wording.
    """
    read = stored(features(docs))
    named = read.where("doc_id is not null and same is not null")
    classes = stored(named.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("sketch").alias("sketch")))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    # An id with several sets belongs to several classes, which it ties together.
    several = named.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select("doc_id")
    ties = named.join(several, "doc_id").join(classes, "same").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    found = links(classes, texts, stored(ties), percent)
    of_class = stored(classes.select("same", "n", "rep").join(found, F.col("rep") == F.col("node"), "left").select("same", "n", F.coalesce("component", "rep").alias("component")))
    joined = lookup(read.select("doc_id", "n_shingles", "same"), of_class, "same")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )
