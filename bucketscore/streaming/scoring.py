"""Scoring a stream of points against a fitted model, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def score_stream(stream: DataFrame, model, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Writer that scores every micro-batch with ``model.transform`` and hands it to ``sink``.

    The bucket table is static and the sums of a point need only its own row, so no state is kept
    and the batch code is used as it is.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: sink(model.transform(batch), number))


def parquet_sink(path: str, *columns: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes every batch to its own folder ``batch=<number>`` of ``path``.

    A batch that is replayed after a failure overwrites its folder, so no row comes twice.
    """

    def write(scored: DataFrame, number: int) -> None:
        chosen = scored.select(*columns) if columns else scored
        chosen.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
