"""Toxicity by two class-conditional Kneser-Ney models over whole words, spelled letter by letter.

A word is an expression ``prefix, next letter, …, end``, and each letter is predicted from all before
it, so inflections that no labelled document has still share what their beginnings say, and words that
only begin alike part where they differ. As Kneser and Ney count, a word weighs by its different
contexts, so that a text copied a thousand times counts once:

* in a class, ``n(prefix)``: the different (two words before, word) triples of its labelled documents
  whose word begins so;
* shared by both classes as the backoff, ``t(prefix)``: the different words of *all* documents that
  begin so.

With the absolute discount ``D`` and the mass ``m`` that it takes from a prefix's continuations,
``p(letter | prefix) = (max(n(prefix letter) - D, 0) + m·t(prefix letter) / t(prefix)) / n(prefix)``,
and the backoff alone where the class lacks the prefix. Continuations with up to ``D`` contexts in both
classes are left to the backoff, which both share, so only longer-counted prefixes need a row; that
is exact and no cut.

A document is judged by its words' log-likelihood ratios, normalised by length: what they have above the
median ratio of the document (bounded by ``USUAL``; it takes out language and subject) and ``MARGIN``
(chance), over the root of the number of words. A logistic curve fitted on other labelled documents
turns that into a score. The plain difference per word, without a margin, drowns a few toxic words
in the noise of the others; the README has the figures.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.llm.rows import fit_logistic, labelled_sample, need, text_and, text_within
from bucketscore.staging import drop, stage

#: Longer runs of letters are cut into words of this length; nothing of them is left out.
LONGEST = 32
WORD = re.compile(rf"[^\W_]{{1,{LONGEST}}}")
#: Letters of scripts without spaces (fixed ranges: Thai to Tibetan, Myanmar, Khmer, kana, Han): words are
#: pairs of neighbours.
SPACELESS = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
#: Ends a word's spelling.
END = "\x00"
#: Absolute discount of a count.
DISCOUNT = 2
#: What a word's log-likelihood ratio may exceed the document's median by without counting.
MARGIN = 2.0
#: How far the median may lie from 0 either way, so that a text of toxic words alone is not usual.
USUAL = 1.0
#: What the ratios are made of.
COUNTS = ("prefix", "ordinary", "toxic", "left_ordinary", "left_toxic", "shared")
#: Words whose ratio a worker keeps.
KEPT_WORDS = 100_000
#: Different words or pairs that a worker gathers before it passes them on.
GATHERED = 20_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, whole; in scripts without spaces all neighbouring pairs."""
    if not text:
        return []
    text = text.lower()
    if not SPACELESS.search(text):
        return WORD.findall(text)
    return WORD.findall(SPACELESS.sub(_pairs, text))


def _pairs(run: re.Match) -> str:
    letters = run.group()
    return f" {' '.join(letters[i : i + 2] for i in range(max(1, len(letters) - 1)))} "


def all_words(docs: DataFrame) -> DataFrame:
    """``(word)``: the different words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[str] = set()

        def fresh(found: set[str]) -> pa.RecordBatch:
            new = found - sent
            if len(sent) > 3 * GATHERED:
                sent.clear()
            sent.update(new)
            return pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], ["word"])

        for batch in batches:
            found: set[str] = set()
            for text in batch.column(0):
                found.update(words_of(text.as_py()))
                if len(found) >= GATHERED:
                    yield fresh(found)
                    found = set()
            yield fresh(found)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string").distinct()


def class_words(docs: DataFrame) -> DataFrame:
    """``(word, ordinary, toxic)``: different pairs of words before it in the documents of each class."""

    def gathered(pairs: set[tuple[int, str, int]]) -> pa.RecordBatch:
        columns = list(zip(*sorted(pairs))) or [(), (), ()]
        types = (pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["label", "word", "before"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: set[tuple[int, str, int]] = set()
            for text, label in zip(batch.column(0), batch.column(1)):
                words, label = words_of(text.as_py()), label.as_py()
                for further, before, word in zip(["", "", *words], ["", *words], words):
                    pairs.add((label, word, zlib.crc32(f"{further} {before}".encode())))
                    if len(pairs) >= GATHERED:
                        yield gathered(pairs)
                        pairs = set()
            yield gathered(pairs)

    pairs = docs.select("text", "label").mapInArrow(run, "label int, word string, before bigint").distinct()
    return pairs.groupBy("word").agg(
        F.count_if(F.col("label") == 0).alias("ordinary"), F.count_if(F.col("label") == 1).alias("toxic")
    )


def _prefixes(word: Column) -> Column:
    """All beginnings of the word with its end, the empty one included."""
    whole = F.concat(word, F.lit(END))
    return F.explode(F.transform(F.sequence(F.lit(0), F.length(whole)), lambda i: F.substring(whole, F.lit(1), i)))


def prefix_counts(counted: DataFrame) -> DataFrame:
    """``(prefix, ordinary, toxic, left_ordinary, left_toxic)`` of ``class_words`` for each prefix with
    more than ``DISCOUNT`` contexts in a class, and the mass that the discount takes from what follows."""
    every = counted.select(_prefixes(F.col("word")).alias("prefix"), "ordinary", "toxic")
    every = every.groupBy("prefix").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    before = F.substring("prefix", F.lit(1), F.length("prefix") - 1)
    taken = [F.least(F.col(c), F.lit(DISCOUNT)) for c in ("ordinary", "toxic")]
    left = every.filter("prefix != ''").groupBy(before.alias("prefix"))
    left = left.agg(F.sum(taken[0]).alias("left_ordinary"), F.sum(taken[1]).alias("left_toxic"))
    kept = every.filter((F.col("ordinary") > DISCOUNT) | (F.col("toxic") > DISCOUNT) | (F.col("prefix") == ""))
    return kept.join(left, "prefix", "left").fillna(0, ["left_ordinary", "left_toxic"])


def with_shared(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """``kept`` with ``shared``, the different words of all documents that begin with the prefix.

    Spark broadcasts ``kept`` where its size allows, so that other prefixes never meet a shuffle.
    """
    begun = all_words(docs).select(_prefixes(F.col("word")).alias("prefix"))
    shared = begun.join(kept.select("prefix"), "prefix", "left_semi").groupBy("prefix")
    return kept.join(shared.agg(F.count(F.lit(1)).alias("shared")), "prefix")


@dataclass(frozen=True, eq=False)
class Ratios:
    """``log_ratios`` by prefix, as two columns: in the driver they take the bytes of the prefixes and numbers.

    Only a worker that looks words up makes the dictionary, once.
    """

    prefixes: pa.Array
    values: np.ndarray

    @cached_property
    def by_prefix(self) -> dict[str, float]:
        return dict(zip(self.prefixes.to_pylist(), self.values.tolist()))

    def get(self, prefix: str) -> float | None:
        return self.by_prefix.get(prefix)


NO_RATIOS = Ratios(pa.array([], pa.string()), np.zeros(0))


def log_ratios(rows: Iterable[tuple]) -> Iterator[float]:
    """``log p(word | toxic) - log p(word | ordinary)`` of words whose longest prefix in the table is that
    of the row, for the rows ``COUNTS`` ordered by prefix. A prefix with ``END`` is a whole word."""

    def backed_off(c: tuple) -> tuple[float, float]:
        return tuple(left / n if n else 1.0 for n, left in ((c[0], c[2]), (c[1], c[3])))

    # Counts of the beginnings of the prefix at hand, and the ratio up to each.
    above: list[tuple[tuple, float]] = []
    for prefix, *own in rows:
        del above[len(prefix) :]
        upto = 0.0
        if prefix:
            counts, upto = above[-1]
            logs = [
                math.log((max(n - DISCOUNT, 0) / total if total else 0.0) + share * own[4] / counts[4])
                for n, total, share in zip(own[:2], counts[:2], backed_off(counts))
            ]
            upto += logs[1] - logs[0]
        above.append((tuple(own), upto))
        ordinary, toxic = (1.0, 1.0) if prefix.endswith(END) else backed_off(own)
        yield upto + math.log(toxic / ordinary)


def read_ratios(table: DataFrame) -> tuple[list[int], Ratios]:
    """Contexts of both classes and ``log_ratios`` of ``with_shared``. Counts and prefixes stay in Arrow."""
    counts = table.select(*COUNTS).orderBy("prefix").toArrow()
    if not counts.num_rows:
        return [0, 0], NO_RATIOS
    totals = [counts.column(c)[0].as_py() for c in ("ordinary", "toxic")]
    if not all(totals):
        return totals, NO_RATIOS
    batches = counts.to_batches(max_chunksize=10_000)
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    values = np.fromiter(log_ratios(rows), np.float64, counts.num_rows)
    # Copied: the column as it came shares its buffers with the counts.
    return totals, Ratios(pa.concat_arrays([*counts.column("prefix").chunks, pa.array([], counts.schema.field("prefix").type)]), values)


def ratio_of(ratios: Ratios | dict[str, float], word: str) -> float:
    whole = word + END
    for length in range(len(whole), -1, -1):
        found = ratios.get(whole[:length])
        if found is not None:
            return found
    return 0.0


@dataclass(frozen=True)
class ToxicityModel:
    """Log-likelihood ratios by the longest known prefix, and the curve from ``excess`` to a score."""

    ratios: Ratios
    weights: tuple[float, float]

    def features(self, docs: DataFrame, *keep: str, within: str | None = None) -> DataFrame:
        """``_keep``, a struct of the ``keep`` columns, and ``excess``: the sum of what ratios have
        above the usual, divided by the root of the length; 0 without words. ``within`` names a struct
        column that has the text and is what is kept."""
        chosen, kind, texts = text_within(docs, within) if within else (*text_and(docs, keep), itemgetter(0))
        # Broadcast once; a worker then reads it from its executor.
        ratios = docs.sparkSession.sparkContext.broadcast(self.ratios)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = ratios.value.by_prefix

            class Words(dict):
                def __missing__(self, word: str) -> float:
                    if len(self) >= KEPT_WORDS:
                        self.clear()
                    found = self[word] = ratio_of(known, word)
                    return found

            look_up = Words().__getitem__
            for batch in batches:
                rows = np.zeros(batch.num_rows)
                for i, text in enumerate(texts(batch)):
                    words = words_of(text.as_py())
                    if words:
                        values = np.fromiter(map(look_up, words), np.float64, len(words))
                        values -= min(max(float(np.median(values)), -USUAL), USUAL)
                        rows[i] = float(np.maximum(values - MARGIN, 0).sum()) / math.sqrt(len(words))
                yield pa.RecordBatch.from_arrays([batch.column("_keep"), pa.array(rows)], ["_keep", "excess"])

        return chosen.mapInArrow(run, f"{kind}, excess double")

    def score(self, docs: DataFrame, *keep: str, within: str | None = None) -> DataFrame:
        """``keep`` columns (or that of ``within``, which has the text) and ``score``, 0 to 1, higher where toxic is likelier."""
        bias, slope = [F.lit(float(w)) for w in self.weights]
        logit = bias + slope * F.col("excess")
        return self.features(docs, *keep, within=within).select("_keep.*", (1 / (1 + F.exp(-logit))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 20_000) -> ToxicityModel:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    The shared counts cover all documents; the driver gets the rows of prefixes that the class models hold,
    which the labelled documents bound. The class models and the curve are classifiers fitted on
    ``max_documents`` labelled documents at most: three quarters of them for the counts, a quarter for
    the curve. Null and empty texts, nulls in ``labels`` and other columns are harmless. With no
    labelled document of a class, the score is 1 where all are toxic, else 0.
    """
    need(docs, "doc_id", "text")
    sample = labelled_sample(labels, "toxic", max_documents)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(4))
    sample = sample.withColumn("part", part)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    kept = stage(prefix_counts(class_words(chosen.filter("part > 0"))), "toxicity-prefixes")
    totals, ratios = read_ratios(with_shared(kept.df, docs))
    drop(docs.sparkSession, kept)
    if not all(totals):
        return ToxicityModel(NO_RATIOS, (40.0 if totals[1] else -40.0, 0.0))

    model = ToxicityModel(ratios, (0.0, 0.0))
    rest = model.features(chosen.filter("part = 0"), "label").select("_keep.label", "excess").toPandas()
    x, y = rest[["excess"]].to_numpy(), rest["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return ToxicityModel(ratios, (math.log(totals[1] / totals[0]), 1.0))
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = fit_logistic(np.c_[np.ones(len(x)), (x - center) / scale], y, ridge=1e-3)
    slopes = weights[1:] / scale
    return ToxicityModel(ratios, (float(weights[0] - slopes @ center), float(slopes[0])))
