"""Document quality by Bradley-Terry ranking of preference pairs.

A pair says that one document is better than another. With features ``x``, the better one wins with
probability ``1 / (1 + exp(-w·(x_better - x_worse)))``; ``w`` minimises the logistic loss over the
pairs. A document's strength is ``w·x``. The cut between kept and rejected documents is a quantile
of the strengths: the one at the share of worse documents in the labelled sample. Strengths become
scores by a curve that passes the given threshold exactly there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscore.functions.running import kth_smallest
from bucketscore.functions.scalar import doubles
from bucketscore.llm.rows import added_up, fit_logistic, labelled, logistic_sums, need, newton, raw, slices, text_and, text_within  # noqa: F401
from bucketscore.llm.shingles import Words
from bucketscore.sources.points import with_row_number
from bucketscore.staging import Staged, passing, stage

FEATURES = (
    "upper", "digit", "symbol", "bang", "pipe", "space", "newline", "stop", "word_length",
    "size", "same_as_before", "distinct", "distinct_by_size", "long_words",
)

# The slopes between which the curve of the scores is fitted.
LOWEST_SLOPE = 1e-6
HIGHEST_SLOPE = 50.1

_CLASS = np.zeros(256, dtype=np.uint8)
for _kind, _bytes in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+<=>@^_~\\/", b"!?", b"|", b" \t", b"\n\r", b".,;:"), 1
):
    _CLASS[list(_bytes)] = _kind


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each whole text; an empty text is all zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, part in slices(texts):
        data, bounds = raw(part)
        size = np.diff(bounds)
        # Counts of a byte class in each text: differences of its running count.
        kinds = _CLASS[data]
        rows = out[first : first + len(part)]
        some = np.maximum(size, 1)
        for kind in range(1, 9):
            running = np.concatenate([[0], np.cumsum(kinds == kind)])
            rows[:, kind - 1] = (running[bounds[1:]] - running[bounds[:-1]]) / some
        words = Words(data, bounds)
        n = words.counts
        known = np.maximum(n, 1)
        rows[:, 8] = np.log1p(size / known)
        rows[:, 9] = np.log1p(n)
        lengths = np.concatenate([[0], np.cumsum(words.ends - words.starts > 24)])
        rows[:, 13] = (lengths[words.bounds[1:]] - lengths[words.bounds[:-1]]) / known
        same = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        same[2:] = np.cumsum(words.hashes[1:] == words.hashes[:-1]) if len(words.hashes) else 0
        for i in np.flatnonzero(n):
            start, stop = words.bounds[i], words.bounds[i + 1]
            distinct = len(np.unique(words.hashes[start:stop]))
            rows[i, 10] = (same[stop] - same[start + 1]) / n[i]
            rows[i, 11] = distinct / n[i]
            rows[i, 12] = math.log1p(distinct) / math.log1p(n[i])
    return out


@dataclass(frozen=True)
class RankingModel:
    """Strength ``w·x``; ``score`` is ``threshold`` where the strength is ``cut``."""

    weights: tuple[float, ...]
    cut: float
    slope: float
    threshold: float

    def score(self, docs: DataFrame, *keep: str, within: str | None = None) -> DataFrame:
        """``keep`` columns, ``strength`` and ``score`` (0 to 1, higher is better) of whole texts.

        ``within`` names a struct column that has the text and is what is kept.
        """
        chosen, kind, texts = text_within(docs, within) if within else (*text_and(docs, keep), itemgetter(0))
        weights = np.array(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # Added feature by feature: a matrix product may round differently from batch to batch.
                strength = np.zeros(batch.num_rows)
                for weight, column in zip(weights, text_features(texts(batch)).T):
                    strength += weight * column
                yield pa.RecordBatch.from_arrays([batch.column("_keep"), pa.array(strength)], ["_keep", "strength"])

        scored = chosen.mapInArrow(run, f"{kind}, strength double")
        logit = F.lit(self.slope) * (F.col("strength") - F.lit(self.cut)) + F.lit(math.log(self.threshold / (1 - self.threshold)))
        return scored.select("_keep.*", "strength", (1 / (1 + F.exp(-logit))).alias("score"))


def _partner(i, k, many: int):
    """The number of the document that document ``i`` of the rarer side meets as its ``k``-th."""
    return (i * 7919 + k * 104_729) % many


def preference_pairs(better: np.ndarray, worse: np.ndarray, per_document: int) -> np.ndarray:
    """Feature differences: each document of the rarer side meets ``per_document`` of the other."""
    few = min(len(better), len(worse))
    i = np.repeat(np.arange(few), per_document)
    j = _partner(i, np.tile(np.arange(per_document), few), max(len(better), len(worse)))
    return better[j] - worse[i] if len(better) >= len(worse) else better[i] - worse[j]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    pairs_per_document: int = 12,
) -> RankingModel:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; 1 is preferred to 0.

    All labelled documents take part; the driver gets sums over them. There are as many pairs as the
    larger side has documents, at least. Null and empty texts have all features 0; nulls in ``labels``
    and other columns are harmless. Without two kinds of labels, every score is 1 (all good, or no
    labels) or 0 (all bad).
    """
    need(docs, "doc_id", "text")
    with passing(docs.sparkSession):
        known = _features(docs).join(labelled(labels, "quality"), "doc_id").select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "x")
        table = stage(known, "quality", better=F.count_if(F.col("label") == 1), worse=F.count_if(F.col("label") == 0))
        better, worse, width = table.facts["better"], table.facts["worse"], len(FEATURES)
        if not better or not worse:
            return RankingModel((0.0,) * width, -1.0 if better or not worse else 1.0, 40.0, threshold)
        spread = table.df.agg(*[F.stddev_pop(F.get("x", F.lit(i))) for i in range(width)]).first()
        scale = np.array(spread, dtype=float) + 1e-9
        pairs = stage(_pairs(table, better, worse, scale, pairs_per_document), "pairs").df

        def sums(weights: np.ndarray) -> np.ndarray:
            return added_up(pairs, lambda x, y: logistic_sums(x, y, weights))

        # A pair is a won comparison; its mirror image, lost, adds the same loss. Sums over differently spread
        # rows differ in their last digits, which the weights leave out.
        weights = tuple(float(f"{w:.10g}") for w in newton(sums, width, ridge=1.0) / scale)
        strength = F.aggregate(F.zip_with("x", doubles(weights), lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
        strengths = stage(table.df.select(strength.alias("strength"), F.col("label").alias("y")), "strengths")
        cut = _quantile(strengths, worse / strengths.rows)
        return RankingModel(weights, cut, _slope(strengths.df, cut, math.log(threshold / (1 - threshold))), threshold)


def _features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the features of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(0))
            bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))], ["_keep", "x"])

    # A null id has no label.
    chosen, kind = text_and(docs.filter(F.col("doc_id").isNotNull()), ("doc_id",))
    return chosen.mapInArrow(run, f"{kind}, x array<double>").select("_keep.doc_id", "x")


def _pairs(table: Staged, better: int, worse: int, scale: np.ndarray, per_document: int) -> DataFrame:
    """``preference_pairs`` of the scaled features as ``(x, y)``; documents are numbered in the order of their ids."""
    scaled = F.zip_with("x", doubles(scale), lambda x, s: x / s)
    ordered = table.df.filter("label in (0, 1)").orderBy("label", "doc_id", F.reverse("x")).select("label", scaled.alias("x"))
    numbered = with_row_number(ordered, "_n")
    sides = {
        0: numbered.filter("label = 0").select("_n", "x"),
        1: numbered.filter("label = 1").select((F.col("_n") - worse).alias("_n"), "x"),
    }
    rarer, few, many = (0, worse, better) if better >= worse else (1, better, worse)
    per = max(per_document, -(-many // few))
    own = sides[rarer].select("_n", "x", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("_k"))
    own = own.select(F.col("x").alias("_own"), _partner(F.col("_n"), F.col("_k"), many).alias("_n"))
    won, lost = ("x", "_own") if rarer == 0 else ("_own", "x")
    gap = F.zip_with(won, lost, lambda a, b: a - b)
    return own.join(sides[1 - rarer], "_n").select(gap.alias("x"), F.lit(1.0).alias("y"))


def _quantile(strengths: Staged, share: float) -> float:
    """The quantile at ``share``, between two documents in proportion."""
    place = share * (strengths.rows - 1)
    low = math.floor(place)
    below, above = (
        kth_smallest(strengths.df, "strength", min(low + step, strengths.rows)).first().kth for step in (1, 2)
    )
    return float(below + (above - below) * (place - low))


def _slope(strengths: DataFrame, cut: float, offset: float) -> float:
    """The slope of a logistic curve through a fixed point, where the gradient of the likelihood is 0.

    The gradient falls as the slope grows, so each pass over the documents narrows the range to one of 63 parts.
    """
    rows = strengths.select(F.array(F.col("strength") - F.lit(cut)).alias("x"), "y")
    low, high = LOWEST_SLOPE, HIGHEST_SLOPE
    while high - low > 1e-10:
        slopes = np.linspace(low, high, 64)

        def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(x * slopes + offset, -35, 35)))
            return (x * (y[:, None] - p)).sum(axis=0)

        rising = int((added_up(rows, sums) - 1e-3 * slopes > 0).sum())
        if rising in (0, 64):
            return float(slopes[min(rising, 63)])
        low, high = float(slopes[rising - 1]), float(slopes[rising])
    return float(f"{(low + high) / 2:.10g}")
