"""Helpers that several operators share: column checks, batches of whole texts, shared tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes through NumPy at a time. A longer text goes alone.
SLICE_BYTES = 2 << 20


def need(df: DataFrame, *names: str) -> None:
    """Raise if a column is missing or occurs twice, so that it could not be named."""
    for name in names:
        if df.columns.count(name) != 1:
            raise ValueError(f"one column {name!r} is needed, found {df.columns.count(name)} in {df.columns}")


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, part)`` of a string array, in parts of about ``SLICE_BYTES``; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, texts.slice(first, last - first)
        first = last


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and the ``len + 1`` bounds of its texts in them."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def remainder(doc_id: Column, by: int) -> Column:
    """``crc32`` of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % by


def labelled_sample(labels: DataFrame, label: str, max_rows: int, id_column: str = "doc_id") -> DataFrame:
    """``labelled``, of at most ``max_rows`` documents, the first by a digest of the id.

    The bound makes the table small enough to broadcast.
    """
    return labelled(labels, label, id_column).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def labelled(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, label)`` of all labelled documents.

    Rows with a null id or label are left out; of contradicting labels of one document the larger counts.
    """
    need(labels, id_column, label)
    rows = labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("label"))
    return rows.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def added_up(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``sums(x, y)`` of the rows ``(x array<double>, y double)``, one array per batch, added up exactly in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                found = sums(x, batch.column(1).to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["total"])

    found = [r.total for r in rows.select("x", F.col("y").cast("double")).mapInArrow(run, "total array<double>").collect()]
    return np.array([math.fsum(c) for c in zip(*found)])


def logistic_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the log likelihood, in one array."""
    p = 1 / (1 + np.exp(-np.clip(x @ weights, -35, 35)))
    return np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression without an intercept of its own, by Newton steps."""
    return newton(lambda weights: logistic_sums(x, y, weights), x.shape[1], ridge, steps)


def newton(sums: Callable[[np.ndarray], np.ndarray], width: int, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """``fit_logistic`` for rows whose ``logistic_sums`` at some weights ``sums`` returns."""
    weights = np.zeros(width)
    for _ in range(steps):
        found = sums(weights)
        gradient = found[:width] - ridge * weights
        curvature = found[width:].reshape(width, width) + ridge * np.eye(width)
        step = np.linalg.solve(curvature, gradient)
        weights = weights + step / max(1.0, float(np.abs(step).max()) / 5)
        if float(np.abs(step).max()) < 1e-9:
            break
    return weights


def text_within(docs: DataFrame, column: str) -> tuple[DataFrame, str, Callable[[pa.RecordBatch], pa.Array]]:
    """``text_and`` of a struct ``column`` that has the ``text`` itself, and what takes the texts from a batch.

    The text goes to Python once, in the row that is carried; only one that is no string goes beside it too.
    """
    need(docs, column)
    if docs.schema[column].dataType["text"].dataType.simpleString() != "string":
        return *text_and(docs.select(column, F.col(column)["text"].alias("_text")), (column,), "_text"), itemgetter(0)
    chosen = docs.select(F.struct(column).alias("_keep"))
    return chosen, f"_keep {chosen.schema['_keep'].dataType.simpleString()}", lambda batch: pc.struct_field(batch.column(0), [column, "text"])


def text_and(docs: DataFrame, keep: tuple[str, ...], text_column: str = "text") -> tuple[DataFrame, str]:
    """The text and one struct ``_keep`` of the columns to carry, and the struct's type.

    As a struct, carried columns pass through Python untouched and cannot clash with new names.
    """
    need(docs, text_column, *keep)
    if not keep:
        raise ValueError("name at least one column to keep")
    chosen = docs.select(F.col(text_column).cast("string").alias("_text"), F.struct(*keep).alias("_keep"))
    return chosen, f"_keep {chosen.schema['_keep'].dataType.simpleString()}"
