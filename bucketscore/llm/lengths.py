"""Exact token totals for every context limit, from a histogram of encoded lengths.

Documents are encoded whole, counted by their length, and never touched again: with ``n(l)``
documents of length ``l``, suffix sums of ``n`` and ``l·n`` give for a limit ``L`` the documents
longer than ``L``, the tokens kept when texts are cut at ``L``, and any quantile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscore.llm.rows import need
from bucketscore.llm.tokens import default_vocabulary, encoding
from bucketscore.staging import stage

#: Lengths that one group of the suffix sums spans.
SPAN = 512


def token_lengths(
    docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, n_tokens)``, one row per row. A null or empty text has 0 tokens."""
    need(docs, id_column, text_column)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(vocabulary) as encode:
            for batch in batches:
                counts = [len(encode(text.as_py() or "")) // 4 for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """``(n_tokens, docs)``; the counts merge on the map side, so a common length is no hot key."""
    return lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, taken as a context limit.

    ``(n_tokens, docs, docs_at_least, tokens_at_least, docs_total, tokens_total, kept_tokens)``:
    documents and tokens of that length or more, all documents and tokens, and the tokens kept when
    every text is cut at that limit. Between two lengths that occur, ``kept_tokens`` is linear. An
    empty table gives no rows. Sums are decimals, so they cannot overflow. The histogram is written
    to the shared folder, since it is read twice and the encoding should run once.
    """
    histogram = stage(histogram, "lengths").df
    wide = "decimal(38,0)"
    rows = histogram.select(
        "n_tokens",
        F.col("docs").cast("bigint").alias("docs"),
        (F.col("n_tokens").cast("decimal(19,0)") * F.col("docs").cast("decimal(18,0)")).cast(wide).alias("tokens"),
        F.floor(F.col("n_tokens") / SPAN).alias("span"),
    )
    # Sums within a span of lengths, plus the totals of all longer spans: as many rows as spans.
    within = Window.partitionBy("span").orderBy(F.col("n_tokens").desc())
    totals = rows.groupBy("span").agg(F.sum("docs").alias("span_docs"), F.sum("tokens").cast(wide).alias("span_tokens"))
    above = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "span",
        F.coalesce(F.sum("span_docs").over(above), F.lit(0)).alias("more_docs"),
        F.coalesce(F.sum("span_tokens").over(above), F.lit(0)).alias("more_tokens"),
        F.sum("span_docs").over(everything).alias("docs_total"),
        F.sum("span_tokens").over(everything).alias("tokens_total"),
    )
    summed = rows.select(
        "span",
        "n_tokens",
        "docs",
        F.sum("docs").over(within).alias("own_docs"),
        F.sum("tokens").over(within).alias("own_tokens"),
    ).join(totals, "span")
    docs_at_least = F.col("own_docs") + F.col("more_docs")
    tokens_at_least = F.col("own_tokens") + F.col("more_tokens")
    cut = F.col("n_tokens") * docs_at_least.cast("decimal(18,0)")
    whole = F.col("tokens_total") - tokens_at_least
    as_long: list[tuple[str, Column]] = [
        ("docs", F.col("docs")),
        ("docs_at_least", docs_at_least),
        ("tokens_at_least", tokens_at_least),
        ("docs_total", F.col("docs_total")),
        ("tokens_total", F.col("tokens_total")),
        ("kept_tokens", whole + cut),
    ]
    return summed.select("n_tokens", *[column.cast("bigint").alias(name) for name, column in as_long])


def totals_at(limits: DataFrame, context: int) -> DataFrame:
    """``(documents, longer, tokens, kept_tokens)`` at any context limit, from the limit table."""
    longer = F.col("n_tokens") > context
    docs, tokens = F.col("docs").cast("decimal(18,0)"), F.col("n_tokens").cast("decimal(19,0)")
    kept = F.least(tokens, F.lit(context).cast("decimal(19,0)")) * docs
    return limits.agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.when(longer, F.col("docs"))), F.lit(0)).alias("longer"),
        F.coalesce(F.sum(tokens * docs), F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(F.sum(kept), F.lit(0)).cast("bigint").alias("kept_tokens"),
    )


def quantile(limits: DataFrame, share: float) -> DataFrame:
    """``n_tokens`` of the document at that share of the order by length: the smallest length with
    at least ``share`` of all documents at or below it."""
    below = F.col("docs_total") - F.col("docs_at_least") + F.col("docs")
    return limits.filter(below >= F.lit(share) * F.col("docs_total")).agg(F.min("n_tokens").alias("n_tokens"))
