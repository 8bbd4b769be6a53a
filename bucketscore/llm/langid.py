"""Language by word frequency, with backoff to shorter and shorter character n-grams.

A word the model knows scores by the logarithm of its frequency in each language. An unknown word
is put between word edges and scored by its longest character n-grams that the model knows any of,
from ``LONGEST`` letters down to single ones; what is unknown throughout favours no language. A text
gets the language with the largest sum over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscore.llm.rows import need, text_and

UNKNOWN = "und"
LONGEST = 5
WORD = re.compile(r"[^\W\d_]+")
EDGE = "\x00"
#: Words whose scores a worker keeps.
KEPT_WORDS = 300_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    if not text:
        return []
    found = WORD.findall(text.lower())
    # Word characters that are neither letters nor decimal digits, such as fractions, end a word.
    return [w for f in found for w in ([f] if f.isalpha() else "".join(c if c.isalpha() else " " for c in f).split())]


def grams(word: str, length: int) -> list[str]:
    if length == 1:
        return list(word)
    edged = f"{EDGE}{word}{EDGE}"
    return [edged[i : i + length] for i in range(len(edged) - length + 1)]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and log frequencies in each of them for words and n-grams."""

    languages: tuple[str, ...]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequencies of the word or of its longest known n-grams (their mean)."""
        known = self.words.get(word)
        if known is not None:
            return np.array(known)
        for length in range(LONGEST, 0, -1):
            found = [self.grams[g] for g in grams(word, length) if g in self.grams]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages))

    def predict(self, docs: DataFrame, *keep: str) -> DataFrame:
        """``keep`` columns, ``lang_pred`` and ``score`` (the language's share of the likelihood per
        word, 0 to 1) for whole texts. A text that is null or has no letter is ``und`` with score 0;
        so is every text if no language was learned. On a tie, the first language by name."""
        model = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = model.value
            scores = np.zeros((KEPT_WORDS, max(1, len(known.languages))))

            class Rows(dict):
                def __missing__(self, word: str) -> int:
                    row = self[word] = len(self)
                    scores[row] = known.word_scores(word) if known.languages else 0.0
                    return row

            rows = Rows()
            for batch in batches:
                names: list[str] = []
                shares = np.zeros(batch.num_rows)
                for i, text in enumerate(batch.column(0)):
                    words = words_of(text.as_py())
                    if not words or not known.languages:
                        names.append(UNKNOWN)
                        continue
                    total = np.zeros(len(known.languages))
                    # A very long text is added up part by part, so that the store can start afresh.
                    for start in range(0, len(words), KEPT_WORDS // 2):
                        part = words[start : start + KEPT_WORDS // 2]
                        if len(rows) + len(part) > KEPT_WORDS:
                            rows.clear()
                        index = np.fromiter(map(rows.__getitem__, part), np.int64, len(part))
                        total += scores[index].sum(axis=0)
                    best = int(np.argmax(total))
                    mean = (total - total[best]) / len(words)
                    names.append(known.languages[best])
                    shares[i] = 1 / np.exp(mean).sum()
                columns = [batch.column(1), pa.array(names, pa.string()), pa.array(shares)]
                yield pa.RecordBatch.from_arrays(columns, ["_keep", "lang_pred", "score"])

        chosen, kind = text_and(docs, keep)
        predicted = chosen.mapInArrow(run, f"{kind}, lang_pred string, score double")
        return predicted.select("_keep.*", "lang_pred", "score")


def _counts(sample: DataFrame) -> DataFrame:
    """``(kind, item, lang, n)``: occurrences of words (kind 0) and n-grams (kind = length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                for word in words_of(text.as_py()):
                    words[lang, word] = words.get((lang, word), 0) + 1
            found: dict[tuple[int, str, str], int] = {}
            for (lang, word), n in words.items():
                found[0, word, lang] = found.get((0, word, lang), 0) + n
                for length in range(1, LONGEST + 1):
                    for gram in grams(word, length):
                        found[length, gram, lang] = found.get((length, gram, lang), 0) + n
            keys = list(zip(*found)) or [(), (), ()]
            columns = [*keys, tuple(found.values())]
            types = (pa.int32(), pa.string(), pa.string(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "item", "lang", "n"])

    rows = sample.select("text", "lang").mapInArrow(run, "kind int, item string, lang string, n bigint")
    return rows.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame,
    max_documents: int = 6_000,
    max_words: int = 100_000,
    max_grams: int = 150_000,
    rare: int = 3,
) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)``: rows with text and language.

    A classifier fitted on about ``max_documents`` rows, drawn by a digest of the id, so that
    neither sources nor files bias it. It keeps at most ``max_words`` words and ``max_grams``
    n-grams, the most frequent that occur ``rare`` times; rarer words back off. Null texts and
    languages are left out, repeated rows count again, other columns are not read.
    """
    need(docs, "doc_id", "text", "lang")
    rows = docs.filter("text is not null and lang is not null")
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.count()
    languages = tuple(sorted(r.lang for r in rows.select("lang").distinct().limit(10_000).collect()))
    share = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter(share < F.lit(max_documents / max(known, 1)))
    counts = _counts(sample)
    counts = counts.groupBy("kind", "item").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")
    )
    counts = counts.filter(F.col("total") >= rare)
    order = [F.col("total").desc(), "kind", "item"]
    found = counts.filter("kind = 0").orderBy(*order).limit(max_words).collect()
    found += counts.filter("kind > 0").orderBy(*order).limit(max_grams).collect()
    totals: dict[int, np.ndarray] = {}
    tables = []
    for row in found:
        counted = np.array([row.by_lang.get(lang, 0) for lang in languages], dtype=float)
        tables.append((row.kind, row.item, counted))
        totals[row.kind] = totals.get(row.kind, 0) + counted
    words: dict[str, tuple[float, ...]] = {}
    parts: dict[str, tuple[float, ...]] = {}
    for kind, item, counted in tables:
        # Half a count for what a language lacks; a language without rows favours nothing.
        logs = np.log(counted + 0.5) - np.log(totals[kind] + 0.5 * len(found))
        (parts if kind else words)[item] = tuple(float(x) for x in logs)
    return LanguageModel(languages, words, parts)
