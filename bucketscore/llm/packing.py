"""Sequence packing by the sum-of-squares rule.

Every partition packs its documents as they come, so no text is shuffled. Whole windows are cut off
a long document first. The piece that remains goes to the fill level that makes the sum of squared
numbers of partially filled windows smallest; a level array holds those numbers. So pieces stay
whole and levels that fit together are kept in stock. What is still partially filled at the end of
the partition, or beyond ``max_open`` windows, is laid end to end and cut at window ends; the very
last window is cut at powers of two, which need no padding. No token is dropped and at most
``max_open`` windows are in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscore.llm.rows import need
from bucketscore.llm.tokens import END_ID, default_vocabulary, encoding

#: (document, first token, ids as little-endian unsigned 32-bit integers, tokens of the document)
Piece = tuple[int | None, int, bytes, int]


class LevelPacker:
    """Windows of ``capacity`` tokens; ``add`` and ``finish`` yield the pieces of closed windows."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def level_for(self, length: int) -> int:
        """The level whose window the piece joins; 0 opens a new one. On a tie, the fullest."""
        last = self.capacity - length
        left, reached = self.counts[: last + 1], self.counts[length : self.capacity + 1]
        # Leaving level h changes the sum by 1 - 2n(h), reaching level h + length by 1 + 2n(h + length).
        change = 2 * (reached - left) + 2
        change[0] += 2 * left[0] - 1
        change[last] -= 2 * reached[last] + 1  # a full window is no longer counted
        change[1:][left[1:] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def add(self, doc: int | None, ids: bytes) -> Iterator[list[Piece]]:
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity:
            yield [(doc, start, ids[4 * start : 4 * (start + self.capacity)], total)]
            start += self.capacity
        if start == total:
            return
        piece = (doc, start, ids[4 * start :], total)
        length = total - start
        level = self.level_for(length)
        window = self.windows[level].pop() if level else []
        window.append(piece)
        if level:
            self.counts[level] -= 1
            self.open -= 1
        if level + length == self.capacity:
            yield window
            return
        self.counts[level + length] += 1
        self.windows[level + length].append(window)
        self.open += 1
        if self.open > self.max_open:
            yield from self.drain()

    def drain(self) -> Iterator[list[Piece]]:
        """Close all windows: their pieces end to end, cut where a window is full."""
        window, room = [], self.capacity
        for level in range(self.capacity, 0, -1):
            for pieces in self.windows[level]:
                for doc, start, ids, total in pieces:
                    while ids:
                        part, ids = ids[: 4 * room], ids[4 * room :]
                        window.append((doc, start, part, total))
                        start += len(part) // 4
                        room -= len(part) // 4
                        if not room:
                            yield window
                            window, room = [], self.capacity
            self.windows[level] = []
        self.counts[:] = 0
        self.open = 0
        yield from self.cut(window, self.capacity - room)

    def cut(self, window: list[Piece], filled: int) -> Iterator[list[Piece]]:
        """One partially filled window as windows whose lengths are powers of two."""
        for bit in range(filled.bit_length() - 1, -1, -1):
            if not filled >> bit & 1:
                continue
            room, first = 1 << bit, []
            while room:
                doc, start, ids, total = window.pop(0)
                first.append((doc, start, ids[: 4 * room], total))
                taken = len(first[-1][2]) // 4
                if 4 * taken < len(ids):
                    window.insert(0, (doc, start + taken, ids[4 * taken :], total))
                room -= taken
            yield first


SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
)
FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
#: Bytes of ids in an output batch.
BATCH_BYTES = 8 << 20


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    max_open: int = 4096,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of all documents.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers; the ids of a
    document end with ``end_id``. ``sequence_id`` is the partition number times 2^33 plus a running
    number, so it depends on how the input is split into partitions and on nothing else.

    A null or empty text is the one id ``end_id``. A null ``doc_id`` stays null. Repeated rows are
    packed each for itself. Of other columns nothing is read. An empty table gives no rows.
    """
    need(docs, id_column, text_column)
    vocabulary = vocabulary or default_vocabulary()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = LevelPacker(capacity, max_open)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        size = 0

        def written(windows: Iterator[list[Piece]]) -> None:
            nonlocal sequence, size
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    length = len(ids) // 4
                    rows.append((doc, start, length, ids, total, sequence, offset))
                    offset += length
                    size += len(ids) + 64
                sequence += 1

        def batch() -> pa.RecordBatch:
            nonlocal size
            columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), FIELDS)]
            rows.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, schema=FIELDS)

        with encoding(vocabulary) as encode:
            for incoming in batches:
                for doc, text in zip(incoming.column(0), incoming.column(1)):
                    written(packer.add(doc.as_py(), encode(text.as_py() or "") + end))
                    if size >= BATCH_BYTES:
                        yield batch()
        written(packer.drain())
        if rows:
            yield batch()

    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
