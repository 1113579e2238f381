"""Exact removal of byte strings that occur twice, with suffix arrays.

A window is every WINDOW-byte string of a text; it is removed wherever it starts more than once.

1. Each window belongs to the GRAM-byte string of least hash inside it. Equal windows choose the same
   string at the same place, so they meet under its hash. Windows of a text that share their choice are
   one context, about three for each WINDOW bytes.
2. Hashes seen once hold unique windows only. Contexts that are equal as a whole are repeated as a
   whole. What remains are different contexts around the same string.
3. These are laid on a grid of BLOCK bytes fixed by the shared string, and a suffix array over the
   blocks is built for a few groups at a time. A window covers CORE whole blocks and, before and after
   them, less than two blocks together: the array brings equal cores side by side, and the remaining bytes are
   then compared for all windows of equal cores.

The suffix array is made by linear grouping: suffixes are grouped by the Lyndon word they start with,
groups are refined in descending order through pointers to the previous smaller suffix, and a second
walk emits the order inside the groups. Nothing is renamed and no recursion takes place.

Scale: the shuffled rows are hashes and places; texts move once for the contexts of step 3 and once
for the removal. A group has at most ``most`` different contexts; the windows of larger ones are told
by a hash of their bytes instead, so that no group has to fit one task. Long texts are read in parts.

Texts are read twice: a first scan counts the hashes, a second one gives only the contexts of those that were
chosen more than once. Passages can also be counted in words (``passages``): a window is then so many words in a row,
whatever their length and the white space between them, and blocks are WORD_BLOCK words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import lookup, mixed, stored

WINDOW = 400
GRAM = 96
WORD_GRAM = 12
WORD = 8  # bytes of the hash of a word
WORD_BLOCK = 8
PASSAGE = 51  # fixed value: a passage of over 50 words
BLOCK = 32
MOST = 20_000
MOST_WORDS = 5_000
PART = 1 << 20
SLICE = 1 << 16
TOGETHER = 128  # contexts whose windows are compared together
FLUSH = 100_000
BATCH = 60_000  # blocks of a suffix array, unless a group has more
BYTE_KEYS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of a list of non-negative integers, by linear grouping.

    Works on the text followed by a sign smaller than all others.
    """
    n = len(text) + 1
    top = max(text, default=0) + 2
    # Groups by first letter: order holds the suffixes, head[i] where the group of suffix i starts.
    counts = [0] * (top + 1)
    counts[1] = 1
    for c in text:
        counts[c + 2] += 1
    for c in range(1, top + 1):
        counts[c] += counts[c - 1]
    head = [counts[c + 1] for c in text]
    head.append(0)
    fill = counts[:]
    order, where = [0] * n, [0] * n
    order[0] = n - 1
    for i, c in enumerate(text):
        at = fill[c + 1]
        fill[c + 1] = at + 1
        order[at] = i
        where[i] = at
    size = [0] * (n + 1)
    for i in range(n):
        size[head[i]] += 1
    smaller = [-1] * n
    times = [0] * n
    end = n
    while end > 1:
        start = head[order[end - 1]]
        # Previous smaller suffix of each member: nothing between it and the member is in a lower group.
        before = []
        for i in sorted(order[start:end]):
            j = i - 1
            while j >= 0 and head[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                if not times[j]:
                    before.append(j)
                times[j] += 1
        if before:
            # Those followed by more copies of this group's word are larger, so they leave first.
            if len(before) == 1:
                rounds = [before]
            else:
                by_times: dict[int, list[int]] = {}
                for j in before:
                    by_times.setdefault(times[j], []).append(j)
                rounds = [by_times[k] for k in sorted(by_times, reverse=True)]
            for members in rounds:
                old = {}
                for j in members:
                    times[j] = 0
                    h = head[j]
                    last = h + size[h] - 1
                    at = where[j]
                    if at != last:
                        other = order[last]
                        order[at], where[other] = other, at
                        order[last], where[j] = j, last
                    size[h] -= 1
                    old[h] = old.get(h, 0) + 1
                for h, moved in old.items():
                    new = h + size[h]
                    if size[h]:
                        size[new] = moved
                        for at in range(new, new + moved):
                            head[order[at]] = new
                    else:
                        size[h] = moved
        end = start
    # Emission: the suffix before each known one is the next of its group, and so are those it extends.
    placed, free, order = [False] * n, list(range(n)), [0] * n
    order[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            h = head[j]
            order[free[h]] = j
            free[h] += 1
            j = smaller[j]
    return order[1:]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of any substring of a byte string or a row of word hashes, by prefix sums modulo 2**64."""

    def __init__(self, size: int):
        self.up, self.down = powers(STEP, size + 1), powers(BACK, size + 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.__init__(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        keys = BYTE_KEYS[data] if data.dtype == np.uint8 else data
        np.cumsum(keys * self.up[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of the given width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def owners(data: np.ndarray, hashes: Hashes, window: int = WINDOW, gram: int = GRAM, whole: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each context: hash of its gram, hash of its bytes and place, place of the gram, first and last window.

    ``whole`` tells which windows lie in one text; others belong to no context.
    """
    prefix = hashes.prefix(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.between(prefix, at, at + gram)
    # High bits choose, low bits are the place: of equal hashes the first one counts.
    chosen = sliding_min((grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64), window - gram + 1)
    windows = np.arange(len(chosen)) if whole is None else np.flatnonzero(whole)
    chosen = chosen[windows]
    breaks = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]][: len(chosen)])
    first = windows[breaks]
    last = windows[np.r_[breaks[1:], len(chosen)] - 1] if len(breaks) else first
    place = (chosen[breaks] & np.uint64(0xFFFFFF)).astype(np.int64)
    context = mixed(hashes.between(prefix, first, last + window) + (place - first).astype(np.uint64))
    return grams[place], context, place, first, last


def laid(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Texts laid end to end, ``size`` bytes or a single text each time: number of the first, bytes, where each starts and the last ends."""
    at = 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) <= size:
            held += len(texts[to])
            to += 1
        yield at, b"".join(texts[at:to]), np.cumsum([0, *map(len, texts[at:to])])
        at = to


def scanned(docs: DataFrame, reader: Callable, window: int, gram: int, part: int, counted: bool) -> DataFrame:
    """doc_id, copy, gram, context, place, first, last for all contexts of ``docs(doc_id, copy, text)``.

    ``reader()`` gives a function from texts laid end to end and their bounds to units (bytes, or hashes of words) and the
    bounds in units. ``part`` units are looked at together. ``counted``: only gram and n, how often it is chosen.
    """
    names = ["doc_id", "copy", "gram", "context", "place", "first", "last"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, units_of = Hashes(1 << 16), reader()
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            size = 0

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                if counted:
                    done = tallied([r[1] for r in rows])
                else:
                    of, *values = (np.concatenate(x) for x in zip(*rows, strict=True))
                    done = pa.RecordBatch.from_arrays(
                        [batch.column(k).take(pa.array(of)) for k in (0, 1)] + [pa.array(x.astype(np.int64)) for x in values], names
                    )
                rows.clear()
                return done

            for number, text, text_bounds in laid(batch.column(2).to_pylist(), min(SLICE, part)):
                units, bounds = units_of(text, text_bounds)
                texts = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for start in range(0, len(units) - window + 1, part):
                    of = texts[start : start + part + window - 1]
                    whole = of[: len(of) - window + 1] == of[window - 1 :]
                    g, c, place, first, last = owners(units[start : start + part + window - 1], hashes, window, gram, whole)
                    of = of[first]
                    rows.append([of + number, g, c, *(x + (start - bounds[of]) for x in (place, first, last))])
                    size += len(g)
                if size > FLUSH:
                    yield out()
                    size = 0
            if rows:
                yield out()

    schema = TALLY if counted else "doc_id long, copy long, gram long, context long, place long, first long, last long"
    return docs.select("doc_id", "copy", "text").mapInArrow(find, schema)


def contexts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, part: int = PART, counted: bool = False) -> DataFrame:
    """As ``scanned``, of the bytes of the texts."""
    return scanned(docs, lambda: lambda text, bounds: (np.frombuffer(text, np.uint8), bounds), window, gram, part, counted)


TALLY = "gram long, n long"


def tallied(grams: list[np.ndarray]) -> pa.RecordBatch:
    found, n = np.unique(np.concatenate(grams), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])


def met(grams: DataFrame, found: DataFrame) -> DataFrame:
    """The contexts of ``found`` whose gram occurs more than once, told by a scan that gives only ``grams`` (gram, n).

    Most contexts of usual text are alone; reading the texts twice keeps them off the disks.
    """
    several = stored(grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1"))
    return stored(lookup(found, several, "gram", how="inner"))


def repeated_windows(texts: list[bytes], places: list[int], window: int = WINDOW, block: int = BLOCK, unit: int = 1) -> list[np.ndarray]:
    """For each context the starts of its windows that occur again among all of them; windows start at multiples of ``unit``.

    ``places`` are those of the shared grams. Windows that differ in the place of their gram relative to
    the grid cannot be equal, so each context has the grid that its gram fixes.
    """
    core = (window - block + unit) // block
    edge = window - core * block  # bytes of a window outside its core
    starts = [p % block for p in places]
    n_blocks = [(len(t) - s) // block for t, s in zip(texts, starts, strict=True)]
    grid = b"".join(t[s : s + n * block] for t, s, n in zip(texts, starts, n_blocks, strict=True))
    blocks = np.frombuffer(grid, np.dtype((np.void, block)))
    _, letters = np.unique(blocks, return_inverse=True)
    # One string of all contexts, a zero after each.
    ends = np.cumsum(n_blocks)
    base = np.r_[0, ends[:-1]] + np.arange(len(texts))
    string = np.zeros(len(letters) + len(texts), np.int64)
    string[np.arange(len(letters)) + np.repeat(np.arange(len(texts)), n_blocks)] = letters.ravel() + 1
    order = np.array(suffix_array(string.tolist()), np.int64)
    left = np.zeros(len(string), np.int64)  # blocks up to the end of the context
    for b, n in zip(base, n_blocks, strict=True):
        left[b : b + n] = np.arange(n, 0, -1)
    order = order[left[order] >= core]
    kind = np.full(len(string), -1, np.int64)
    if len(order):
        views = np.lib.stride_tricks.sliding_window_view(string, core)
        same = np.empty(len(order), bool)
        same[0] = False
        for at in range(1, len(order), 1 << 16):  # in slices, as every row is core numbers
            cut = order[at - 1 : at + (1 << 16)]
            rows = views[cut]
            same[at : at + len(cut) - 1] = (rows[1:] == rows[:-1]).all(axis=1)
        number = np.cumsum(~same) - 1
        shared = np.bincount(number)[number] > 1
        kind[order[shared]] = number[shared]
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(texts), TOGETHER):
        some = texts[low : low + TOGETHER]
        # All windows of these contexts, and the first whole block of each.
        sizes = np.array([max(0, len(t) - window + unit) // unit for t in some], np.int64)
        which = np.repeat(np.arange(len(some)), sizes)
        begin = (np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * unit
        shift = np.array(starts[low : low + TOGETHER], np.int64)[which]
        first_block = np.maximum(-((shift - begin) // block), 0)
        group = kind[base[low + which] + first_block]
        shared = np.flatnonzero(group >= 0)
        which, begin, group = which[shared], begin[shared], group[shared]
        before = shift[shared] + block * first_block[shared] - begin
        # The bytes outside the blocks tell windows of equal cores apart.
        data = np.frombuffer(b"".join(some), np.uint8)
        at = np.cumsum([0, *map(len, some)])[which] + begin
        key = mixed((group * (block + 1) + before).astype(np.uint64))
        reach = np.arange(edge)[None, :]
        outside = np.zeros((len(at), -(-edge // 8) * 8), np.uint8)
        outside[:, :edge] = data[at[:, None] + np.where(reach < before[:, None], reach, reach + core * block)]
        for column in outside.view(np.uint64).T:
            key = mixed(key + mixed(column + np.uint64(STEP)))
        found.append((which + low, begin, key))
    which, begin, key = (np.concatenate(x) for x in zip(*found, strict=True))
    _, number, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[number] > 1
    which, begin = which[twice], begin[twice]
    cuts = np.searchsorted(which, np.arange(len(texts) + 1))
    return [begin[cuts[x] : cuts[x + 1]] for x in range(len(texts))]


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.r_[0, breaks + 1]], starts[np.r_[breaks, len(starts) - 1]]


SPANS = "doc_id long, copy long, start long, end long"


def grid_spans(asked: DataFrame, window: int, block: int = BLOCK, unit: int = 1, batch_blocks: int = BATCH) -> DataFrame:
    """Spans to remove from ``asked(gram, doc_id, copy, first, n, offset, bytes)``, groups by gram; places count units of bytes."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        blocks = 0

        def out():
            found = repeated_windows([r[5] for r in waiting], [r[4] for r in waiting], window, block, unit)
            rows: list[tuple] = []
            for (doc_id, copy, first, n, *_), starts in zip(waiting, found, strict=True):
                if n == 1 and len(starts):  # contexts that occur twice are removed as a whole elsewhere
                    rows.extend((doc_id, copy, first + int(a), first + int(b) + window // unit) for a, b in zip(*runs(starts // unit), strict=True))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "copy", "start", "end"])

        last = None
        for batch in batches:
            for gram, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gram != last and blocks >= batch_blocks:
                    yield out()
                    waiting, blocks = [], 0
                last = gram
                waiting.append(tuple(row))
                blocks += len(row[-1]) // block
        if waiting:
            yield out()

    dealt = asked.repartition("gram").sortWithinPartitions("gram")
    return dealt.select("gram", "doc_id", "copy", "first", "n", "offset", "bytes").mapInArrow(solve, SPANS)


def hashed_spans(asked: DataFrame, window: int, unit: int = 1) -> DataFrame:
    """The same for groups too large for one task: windows are told by a 128-bit hash of their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, copy, first, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                keys = [xxhash.xxh3_128_digest(text[s : s + window]) for s in range(0, len(text) - window + 1, unit)]
                k = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array([doc_id] * k, pa.int64()), pa.array([copy] * k, pa.int64()), pa.array(range(first, first + k), pa.int64())],
                    ["bytes", "doc_id", "copy", "start"],
                )

    each = stored(asked.select("doc_id", "copy", "first", "bytes").mapInArrow(cut, "bytes binary, doc_id long, copy long, start long"))
    several = stored(each.groupBy("bytes").agg(F.count("*").alias("n")).where("n > 1"))
    return lookup(each, several, "bytes", how="inner").select("doc_id", "copy", "start", (F.col("start") + window // unit).alias("end"))


def with_copy(docs: DataFrame) -> DataFrame:
    """Text as bytes, null as empty, and copy, a hash that tells texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn("text", text).withColumn("copy", F.xxhash64("text"))


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, part: int = PART) -> DataFrame:
    """All spans (doc_id, copy, start, end) of bytes to remove from ``docs`` as ``with_copy`` gives them."""
    read = docs.select("doc_id", "copy", "text")
    long_enough = read.where(F.length("text") >= window)
    found = met(contexts(long_enough, window, gram, part, counted=True), contexts(long_enough, window, gram, part))

    def bytes_of(text: bytes, first: int, last: int) -> bytes:
        return text[first : last + window]

    return told(read, found, lambda: bytes_of, window, min(BLOCK, max(1, window // 2)), 1, most)


def told(read: DataFrame, found: DataFrame, reader: Callable, window: int, block: int, unit: int, most: int) -> DataFrame:
    """Spans of repeated windows of the contexts ``found``, in units; ``reader()`` gives a function that takes a context out of a text."""
    kinds = stored(
        found.groupBy("gram", "context").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "copy", "first", "last", "place")).alias("one")
        )
    )
    groups = stored(kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.count("*").alias("n")).where("kinds > 1"))
    # Contexts that are repeated as a whole.
    whole = stored(kinds.where("n > 1").select(F.struct("gram", "context").alias("which"), "n"))
    repeated = lookup(found.withColumn("which", F.struct("gram", "context")), whole, "which", how="inner").select(
        "doc_id", "copy", F.col("first").alias("start"), (F.col("last") + window // unit).alias("end")
    )
    # Different contexts of one gram: their bytes are fetched, one text per kind.
    different = lookup(kinds, groups, "gram", how="inner")
    wanted = different.select(
        F.col("one.doc_id").alias("doc_id"),
        F.col("one.copy").alias("copy"),
        F.struct("gram", "kinds", "n", "one.first", "one.last", "one.place").alias("want"),
    )
    wanted = wanted.groupBy("doc_id", "copy").agg(F.collect_list("want").alias("wants"))  # no more than the text has contexts
    once = read.join(wanted, (read["doc_id"].eqNullSafe(wanted["doc_id"])) & (read["copy"] == wanted["copy"])).select(
        read["doc_id"], read["copy"], "text", "wants"
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = reader()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, copy, text, wants in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend(
                    (w["gram"], w["kinds"], doc_id, copy, w["first"], w["n"], (w["place"] - w["first"]) * unit, taken(text, w["first"], w["last"]))
                    for w in wants
                )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds_of = [*[pa.int64()] * 7, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], ["gram", "kinds", "doc_id", "copy", "first", "n", "offset", "bytes"]
            )

    asked = stored(once.mapInArrow(fetch, "gram long, kinds long, doc_id long, copy long, first long, n long, offset long, bytes binary"))
    out = repeated.unionByName(grid_spans(asked.where(F.col("kinds") <= most), window, block, unit))
    large = asked.where(F.col("kinds") > most)
    return out if large.isEmpty() else out.unionByName(hashed_spans(large, window, unit))


def word_places(text: bytes, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a text, split at ASCII white space and at ``bounds``."""
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    apart = np.zeros(len(data) + 1, bool)
    apart[[0, len(data)]] = True
    if bounds is not None:
        apart[bounds] = True
    starts = apart[:-1].copy()
    starts[1:] |= space[:-1]
    ends = apart[1:].copy()
    ends[:-1] |= space[1:]
    return np.flatnonzero(starts & ~space), np.flatnonzero(ends & ~space) + 1


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, hashes: Hashes, most: int = PART) -> np.ndarray:
    """64-bit hashes of the words at these places, ``most`` bytes of text at a time, however long a word is."""
    sums, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        for low in range(int(starts[at]), int(ends[to - 1]), most):
            prefix = hashes.prefix(np.frombuffer(text, np.uint8, min(most, int(ends[to - 1]) - low), low))
            if to > at + 1 or low == starts[at]:
                found = (prefix[np.minimum(ends[at:to] - low, len(prefix) - 1)] - prefix[starts[at:to] - low]) * hashes.down[starts[at:to] - low]
            else:  # the next bytes of a word longer than ``most``
                found = prefix[-1:] * np.uint64(pow(STEP, low - int(starts[at]), 1 << 64))
            sums[at:to] += found
        at = to
    return mixed(sums)


def word_contexts(docs: DataFrame, words: int, gram: int, part: int, counted: bool = False) -> DataFrame:
    """As ``scanned``, of the words of the texts; places are counted in words."""

    def reader():
        hashes = Hashes(1 << 12)

        def units(text: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            starts, ends = word_places(text, bounds)
            return word_hashes(text, starts, ends, hashes), np.searchsorted(starts, bounds)

        return units

    return scanned(docs, reader, words, gram, part, counted)


def passages(docs: DataFrame, words: int, gram: int = WORD_GRAM, most: int = MOST_WORDS, part: int = PART >> 3) -> DataFrame:
    """Spans (doc_id, copy, start, end) of all passages of ``words`` words that start more than once, counted in words.

    A suffix array over blocks of words tells them, as it does over blocks of bytes: a word is its 64-bit hash.
    """
    read = docs.select("doc_id", "copy", "text")
    long_enough, gram = read.where(F.length("text") >= 2 * words - 1), min(gram, words)
    found = met(word_contexts(long_enough, words, gram, part, counted=True), word_contexts(long_enough, words, gram, part))

    def reader():
        hashes, last = Hashes(1 << 12), (None, None)

        def hashes_of(text: bytes, first: int, to: int) -> bytes:
            nonlocal last
            if last[0] is not text:
                last = text, word_places(text)
            starts, ends = last[1]
            return word_hashes(text, starts[first : to + words], ends[first : to + words], hashes).tobytes()

        return hashes_of

    return told(read, found, reader, words * WORD, min(WORD_BLOCK, max(1, words // 2)) * WORD, WORD, most)


def in_bytes(text: bytes, found: list[dict]) -> list[dict]:
    """Spans counted in words as spans of bytes, from the first word's start to the last word's end."""
    starts, ends = word_places(text)
    return [{"start": int(starts[x["start"]]), "end": int(ends[x["end"] - 1])} for x in found]


def covered(found: list[dict]) -> tuple[int, int]:
    """How many places the spans cover, and in how many runs; spans that touch are one run."""
    n, n_runs, end = 0, 0, -1
    for start, stop in sorted((x["start"], x["end"]) for x in found):
        n_runs += start > end
        n += max(0, stop - max(start, end))
        end = max(end, stop)
    return n, n_runs


def cut_text(text: bytes, found: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs; spans that touch are one run."""
    if not found:
        return text, 0, 0
    kept, at, n_runs, removed = [], 0, 0, 0
    end = -1
    for start, stop in sorted((x["start"], x["end"]) for x in found):
        if start > end:
            kept.append(text[at:start])
            n_runs += 1
            removed += stop - start
        elif stop > end:
            removed += stop - end
        end = max(end, stop)
        at = end
    kept.append(text[at:])
    return b"".join(kept), removed, n_runs


def removed(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, part: int = PART, as_text: bool = False,
    words: int | None = None, cut_words: bool = True,
) -> DataFrame:
    """Struct ``row`` with the columns of ``docs`` but text, and n_bytes, n_removed, n_spans, kept, n_passage_words, n_passage_spans.

    ``kept`` is binary, or with ``as_text`` a string, without characters of which only a part is left.
    With ``words``, passages of that many words that occur twice are found too, however few bytes they have: the last
    two columns count their words and runs (null without ``words``). With ``cut_words`` they are removed too.

    One row per input row. A null text is empty. Rows that repeat another row are two documents, so
    texts of at least WINDOW bytes vanish from both.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = with_copy(docs.select(others.alias("row"), "doc_id", "text"))
    found = spans(rows, window, gram, most, part).withColumn("unit", F.lit("byte"))
    if words:
        found = found.unionByName(passages(rows, words).withColumn("unit", F.lit("word")))
    listed = [F.collect_list(F.when(F.col("unit") == u, F.struct("start", "end"))).alias(f"{u}s") for u in ("byte", "word")]
    found = found.distinct().groupBy("doc_id", "copy").agg(*listed)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["copy"] == found["copy"]), "left").select("row", "text", "bytes", "words")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            texts = batch.column(1).to_pylist()
            for text, byte_spans, word_spans in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = list(byte_spans or [])
                if word_spans and cut_words:
                    gone += in_bytes(text, word_spans)
                done.append((*cut_text(text, gone), *(covered(word_spans or []) if words else (None, None))))
            counts = [pa.array([d[k] for d in done], pa.int64()) for k in range(1, 5)]
            kept = pa.array([d[0].decode("utf-8", "ignore") for d in done], pa.string()) if as_text else pa.array([d[0] for d in done], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), *counts[:2], kept, *counts[2:]],
                ["row", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words", "n_passage_spans"],
            )

    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        cut,
        f"row {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, n_passage_words long, n_passage_spans long",
    )


def digest(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and how many words stand in passages of ``words`` words that occur twice, in how many runs."""
    return removed(docs.select("doc_id", "text"), words=words, cut_words=False).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words", "n_passage_spans"
    )
