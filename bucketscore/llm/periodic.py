"""Runs of repeated words in texts, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q that holds at least ``MIN_POWER``
periods and ``MIN_WORDS`` words and that no neighbouring word extends. All texts of a slice are
searched together; words of different texts have different numbers, so nothing matches across texts.

1. Names by doubling: the class of the 2^k words from each position on, for k = 0, 1, ..., refined
   until all classes have one member. The order that results is the suffix array; a class is an
   interval of it, so every level is a dictionary of basic factors.
2. A run of period q contains a block of 2^k words, placed at a multiple of 2^k, together with its
   copy q words on, where 2^k is about 1.5 q at most. So every block whose class has several members
   asks where it occurs next in the window of distances that its level stands for: a range successor
   in a wavelet tree over the suffix array.
3. The starts of one block in a window shorter than the block form an arithmetic progression. Its
   first and last member are tested; with three or more, the block itself repeats with the
   difference, and the stretches of that small period around the block and around the progression
   must end alike, which leaves two distances to test.
4. A distance becomes a run by the longest common extensions to the left and right, read off the
   names. Multiples of a period give the same stretch as the period, and the smallest one counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscore.llm.rows import SLICE_BYTES, text_and

MIN_POWER = 4
MIN_WORDS = 6


class Names:
    """Classes of equal stretches of 2^k numbers, for every level k, and the suffix array."""

    def __init__(self, numbers: np.ndarray):
        self.n = n = len(numbers)
        order = np.argsort(numbers, kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = numbers[order][1:] != numbers[order][:-1]
        name = np.empty(n, dtype=np.int32)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        name[order] = np.repeat(starts, sizes)
        size = np.zeros(n, dtype=np.int32)
        size[starts] = sizes
        #: ``name[k][i]``: first slot in the suffix array of the class of the 2^k numbers from i on.
        self.name, self.size = [name], [size]
        slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
        step = 1
        while len(slots):
            at = order[slots]
            after = np.full(len(at), -1, dtype=np.int64)
            inside = at + step < n
            after[inside] = name[at[inside] + step]
            key = name[at].astype(np.int64) * (n + 1) + after + 1
            sorting = np.argsort(key, kind="stable")
            key = key[sorting]
            order[slots] = at[sorting]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lengths = np.diff(np.append(first, len(key)))
            name, size = name.copy(), size.copy()
            size[slots] = 0
            size[slots[first]] = lengths
            name[order[slots]] = np.repeat(slots[first], lengths)
            self.name.append(name)
            self.size.append(size)
            slots = slots[np.repeat(lengths > 1, lengths)]
            step *= 2
        self.order = order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from ``i`` and from ``j`` on are equal; ``i`` and ``j`` differ."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.name) - 1, -1, -1):
            inside = np.maximum(i, j) < self.n
            last = self.n - 1
            same = inside & (self.name[k][np.minimum(i, last)] == self.name[k][np.minimum(j, last)])
            step = same.astype(np.int64) << k
            i, j, total = i + step, j + step, total + step
        return total

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers before ``i`` and before ``j`` are equal; ``i`` and ``j`` differ."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.name) - 1, -1, -1):
            left, right = i - (1 << k), j - (1 << k)
            inside = np.minimum(left, right) >= 0
            same = inside & (self.name[k][np.maximum(left, 0)] == self.name[k][np.maximum(right, 0)])
            step = same.astype(np.int64) << k
            i, j, total = i - step, j - step, total + step
        return total


class WaveletTree:
    """Counts and order statistics of any interval of a sequence of numbers below ``limit``."""

    def __init__(self, values: np.ndarray, limit: int):
        self.bits = max(1, int(limit).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            high = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(~high, out=zeros[1:])
            self.zeros.append(zeros)
            values = np.concatenate([values[~high], values[high]])

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the slots ``low:high`` hold less than ``value``."""
        count = np.zeros(len(low), dtype=np.int64)
        for depth, zeros in enumerate(self.zeros):
            one = (value >> (self.bits - 1 - depth) & 1).astype(bool)
            a, b = zeros[low], zeros[high]
            count += np.where(one, b - a, 0)
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return count

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with ``k`` smaller ones among the slots ``low:high``, which must exist."""
        found = np.zeros(len(low), dtype=np.int64)
        k = k.copy()
        for depth, zeros in enumerate(self.zeros):
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k -= np.where(one, b - a, 0)
            found |= one.astype(np.int64) << (self.bits - 1 - depth)
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return found


class Occurrences:
    """Where blocks with several occurrences occur: range successor over the suffix array."""

    def __init__(self, names: Names):
        # Only positions whose two words occur again can be the start of a block that does.
        self.names = names
        level = min(1, len(names.name) - 1)
        several = names.size[level][names.name[level]] > 1
        self.positions = np.flatnonzero(several)
        self.rank = np.zeros(names.n + 1, dtype=np.int64)
        np.cumsum(several, out=self.rank[1:])
        kept = several[names.order]
        self.slot = np.zeros(names.n + 1, dtype=np.int64)
        np.cumsum(kept, out=self.slot[1:])
        self.tree = WaveletTree(self.rank[names.order[kept]], len(self.positions) + 1)

    def interval(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the class of the blocks at ``at``."""
        first = self.names.name[level][at]
        return self.slot[first], self.slot[first + self.names.size[level][first]]

    def smaller(self, slots: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> np.ndarray:
        """The number of members of a class that lie before ``start``."""
        return self.tree.below(*slots, self.rank[np.minimum(start, self.names.n)])

    def member(self, slots: tuple[np.ndarray, np.ndarray], k: np.ndarray) -> np.ndarray:
        return self.positions[self.tree.kth(*slots, k)]


def _distances(level: int) -> tuple[int, int]:
    """Smallest and largest period that blocks of 2^level words stand for."""
    def least(block: int) -> int:
        # 2 * block - 1 + q <= MIN_POWER * q: the block and its copy fit wherever the run begins.
        return -(-(2 * block - 1) // (MIN_POWER - 1))

    return (1 if level == 1 else least(1 << level)), least(2 << level) - 1


def find_runs(numbers: np.ndarray) -> np.ndarray:
    """``(start, end, period)`` of all runs of a sequence, by start and period."""
    none = np.zeros((0, 3), dtype=np.int64)
    if len(numbers) < MIN_WORDS:
        return none
    names = Names(numbers)
    occurrences = Occurrences(names)
    tests: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(1, len(names.name)):
        block = 1 << level
        least, most = _distances(level)
        if MIN_POWER * least > names.n:
            break
        at = np.arange(0, names.n, block, dtype=np.int64)
        at = at[names.size[level][names.name[level][at]] > 1]
        slots = occurrences.interval(level, at)
        before, upto = occurrences.smaller(slots, at + least), occurrences.smaller(slots, at + most + 1)
        found = upto > before
        at, before, upto = at[found], before[found], upto[found]
        slots = (slots[0][found], slots[1][found])
        if not len(at):
            continue
        first = occurrences.member(slots, before)
        last = occurrences.member(slots, upto - 1)
        few = upto - before <= 2
        tests += [(at[few], first[few] - at[few]), (at[few], last[few] - at[few])]
        # A progression: the ends of the stretches with its difference say how far they are apart.
        at, first, many = at[~few], first[~few], (slots[0][~few], slots[1][~few])
        gap = occurrences.member(many, before[~few] + 1) - first
        left = (first - names.behind(first, first + gap)) - (at - names.behind(at, at + gap))
        right = (first + names.ahead(first, first + gap)) - (at + names.ahead(at, at + gap))
        for distance in (left, right):
            fits = (distance >= least) & (distance <= most)
            tests.append((at[fits], distance[fits]))
    if not tests:
        return none
    at, period = (np.concatenate(column) for column in zip(*tests))
    start = at - names.behind(at, at + period)
    end = at + period + names.ahead(at, at + period)
    long = end - start >= np.maximum(MIN_WORDS, MIN_POWER * period)
    start, end, period = start[long], end[long], period[long]
    sorting = np.lexsort((period, end, start))
    runs = np.stack([start, end, period], axis=1)[sorting]
    if not len(runs):
        return none
    fresh = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The columns ``keep``, then ``n_words``, ``runs`` and ``collapsed`` of every row.

    ``runs`` is an array of ``(start, length, period)`` in words from 0, by start, then period.
    ``collapsed`` is the text without the repetitions: of every run only its first period stays,
    words are joined by one space. Words are what lies between ASCII white space; case counts.

    A null or empty text has no words, no runs and an empty ``collapsed``. Rows are independent:
    repeated rows repeat their result, an empty table gives no rows, and other columns are not read.
    A text is taken whole; its names need some 8 bytes per word and level of doubling.
    """
    chosen, kept = text_and(docs, keep, text_column)
    schema = f"{kept}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first = batch.column(0), 0
            while first < batch.num_rows:
                last, size = first, 0
                while last < batch.num_rows and (last == first or size < SLICE_BYTES):
                    size += len(texts[last].as_buffer() or b"") if texts[last].is_valid else 0
                    last += 1
                yield _collapse(texts.slice(first, last - first), batch.column(1).slice(first, last - first))
                first = last

    found = chosen.select("_text", "_keep").mapInArrow(run, schema)
    return found.select("_keep.*", "n_words", "runs", "collapsed")


def _collapse(texts: pa.Array, keep: pa.Array) -> pa.RecordBatch:
    """The result for some texts, whose words are numbered and searched together."""
    # bytes.split() parts at space, tab, line feed, vertical tab, form feed and carriage return.
    words = [text.as_buffer().to_pybytes().split() if text.is_valid else [] for text in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    bounds = np.append(0, np.cumsum(counts))
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=bounds[-1])
    numbers += np.repeat(np.arange(len(words), dtype=np.int64) * len(known), counts)
    runs = find_runs(numbers)
    owner = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    edges = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 1], -1)
    dropped = np.cumsum(edges[:-1]) > 0
    touched = set(owner.tolist())
    collapsed = []
    for i, row in enumerate(words):
        if i in touched:
            row = [word for word, gone in zip(row, dropped[bounds[i] : bounds[i + 1]].tolist()) if not gone]
        collapsed.append(b" ".join(row))
    lists = np.append(0, np.cumsum(np.bincount(owner, minlength=len(words)))).astype(np.int32)
    fields = [runs[:, 0] - bounds[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    items = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"])
    columns = [keep, pa.array(counts), pa.ListArray.from_arrays(pa.array(lists), items), pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["_keep", "n_words", "runs", "collapsed"])


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where one text in ten, by the crc32 of its id, ends in a repetition.

    With h that crc32 and g = h div 10, the words from number ``a = g mod n`` on are replaced by
    their first ``1 + (n - a) div (3 + g mod 8)`` words over and over. Rows with a null id stay.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, h in enumerate(batch.column(2).to_pylist()):
                words = texts[i].encode().split() if texts[i] and h is not None and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    period = 1 + (n - a) // (3 + g % 8)
                    tail = words[a : a + period] * (-(-(n - a) // period))
                    texts[i] = b" ".join(words[:a] + tail[: n - a]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest run, and digests of all runs and of the rest."""
    better = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.try_element_at("runs", F.lit(1)),
        lambda best, run: F.when(run["length"] > best["length"], run).otherwise(best),
    )
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    rows = found.select("doc_id", "runs", better.alias("best"), F.concat_ws("", lines).alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
