"""Document fingerprints from closed syncmers.

A window of ``K`` bytes of a text is an anchor if the smallest of the hashes of its ``S``-byte parts
is the first or the last. That depends on the window alone, not on its surroundings, so two texts
choose the same anchors wherever they agree, and at least one in any ``K - S + 1`` windows in a row
(unless hashes tie). A fingerprint is the ``KEPT`` anchors with the smallest hashes, each with its
first position in the text. Two fingerprints are compared by position: the anchors they share must
lie the same distance apart in both texts, and their share of the smallest of the union estimates
the share of common anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscore.llm.rows import mix, need

K, S = 16, 8
KEPT = 64
#: Bytes by which shared anchors may shift against each other.
SLACK = 32
#: Bytes that anchors are searched in at a time.
CHUNK = 1 << 18


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, position)`` of all closed syncmers of a text's bytes."""
    if len(data) < K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = data.astype(np.uint64)
    part = wide[: len(data) - S + 1].copy()
    for i in range(1, S):
        part |= wide[i : len(data) - S + 1 + i] << np.uint64(8 * i)
    order = mix(part)
    span = K - S + 1
    # Minima of spans of 2, 4, 8, … parts, of which two cover a window.
    low, width = order, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    windows = len(data) - K + 1
    low = np.minimum(low[:windows], low[span - width : span - width + windows])
    at = np.flatnonzero((order[:windows] == low) | (order[span - 1 : span - 1 + windows] == low))
    value = np.zeros(len(at), np.uint64)
    for start in range(0, K, S):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + part[at + start])
    return value, at


def smallest(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``KEPT`` smallest different hashes and their first positions."""
    short = value >> np.uint64(32)
    if len(short) > 4 * KEPT:
        limit = np.partition(short, 4 * KEPT)[4 * KEPT]
        some = short <= limit
        if len(np.unique(short[some])) >= KEPT:
            short, at = short[some], at[some]
    order = np.lexsort((at, short))
    short, at = short[order], at[order]
    first = np.ones(len(short), dtype=bool)
    first[1:] = short[1:] != short[:-1]
    return short[first][:KEPT], at[first][:KEPT]


def sketch(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Smallest anchors of the whole text. Without anchors, the text's own hash at position 0."""
    data = np.frombuffer(text, dtype=np.uint8)
    kept = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for start in range(0, max(len(data) - K + 1, 1), CHUNK):
        value, at = smallest(*anchors(data[start : start + CHUNK + K - 1]))
        value, at = np.concatenate([kept[0], value]), np.concatenate([kept[1], at + start])
        kept = smallest(value << np.uint64(32), at)
    if not len(kept[0]):
        own = int.from_bytes(hashlib.sha256(text).digest()[:4], "big")
        kept = np.array([own], np.uint64), np.zeros(1, np.int64)
    return kept


def written(found: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash:position`` in hexadecimal, comma-separated, by hash."""
    return ",".join(f"{value:08x}:{at:x}" for value, at in zip(found[0].tolist(), found[1].tolist()))


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; 1 for equal fingerprints. Of the smallest anchors of both together, the share that
    both have at the distance from each other that most of them have."""
    together = np.unique(np.concatenate([one[0], other[0]]))[:KEPT]
    shared, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    inside = np.isin(shared, together, assume_unique=True)
    if not inside.any():
        return 0.0
    shift = np.sort((one[1][i] - other[1][j])[inside])
    most = int((np.searchsorted(shift, shift + SLACK, side="right") - np.arange(len(shift))).max())
    return most / len(together)


OUTPUT = (
    ("doc_id", "bigint", pa.int64()),
    ("n_chars", "bigint", pa.int64()),
    ("edited_sha256", "string", pa.string()),
    ("fingerprint", "string", pa.string()),
    ("edited_fingerprint", "string", pa.string()),
    ("near_edited", "double", pa.float64()),
    ("near_next", "double", pa.float64()),
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of ``docs(doc_id, text)``, one row per row. A null text is empty."""
    need(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written(sketch((text.as_py() or "").encode())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, fingerprint string")


def _bounds(docs: DataFrame, rows_per_range: int, max_ranges: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Cuts between ranges of ids, and ``(range, first doc_id)`` of those that have rows, in order.

    Ids are cut at quantiles; how good those are only decides how even the ranges are.
    """
    ids = docs.select("doc_id").filter("doc_id is not null")
    count = ids.count()
    parts = max(1, min(max_ranges, -(-count // rows_per_range)))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(map(int, set(ids.approxQuantile("doc_id", shares, 1 / (4 * parts)))), reverse=True) if shares else []
    found = ids.groupBy(_range_of(F.col("doc_id"), cuts).alias("range")).agg(F.max("doc_id").alias("first")).collect()
    return cuts, sorted((r["range"], r["first"]) for r in found)


def _range_of(doc_id, cuts: list[int]):
    """0 for the largest ids. The cuts are a literal array, one entry per range."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut > doc_id))


def edits(docs: DataFrame, rows_per_range: int = 4_000, max_ranges: int = 1024) -> DataFrame:
    """Every document, its edited text and the next document, by fingerprint.

    Documents are in descending order of ``doc_id``; after the last comes the first. The edited text
    is the document with its last third replaced by as many code points from the start of the next
    one (or all it has). Rows: ``OUTPUT``. Each range of ids goes to one task in order, with a copy
    of the first document of the following range, so texts move once and only neighbours are held. The
    ranges' bounds are literals in the plan, hence ``max_ranges``; a longer range sorts on disk.

    A null text is empty. Null ids come last; equal ids are ordered by text, nulls first. A single
    document is its own next. An empty table gives no rows. Other columns are not read.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts, found = _bounds(docs, rows_per_range, max_ranges)
    last = len(cuts)
    place = F.when(F.col("doc_id").isNull(), F.lit(last + 1)).otherwise(_range_of(F.col("doc_id"), cuts))
    # A range's first document is also the next one after the range before it, circularly. Null ids
    # have a range of their own at the end; its first document is the first by text.
    ranges = [r for r, _ in found]
    heads = {first: ranges[i - 1] for i, (_, first) in enumerate(found)}
    nulls = docs.filter("doc_id is null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("none"))
    null_head = nulls.orderBy(F.col("none").desc(), "text").limit(1).collect()
    copies = F.create_map(*[F.lit(x) for first, r in heads.items() for x in (first, r)]) if heads else None
    if null_head and heads:
        heads[found[0][1]] = last + 1
        copies = F.create_map(*[F.lit(x) for first, r in heads.items() for x in (first, r)])
    ghost = F.when(F.col("doc_id").isNotNull(), F.try_element_at(copies, F.col("doc_id"))) if heads else F.lit(None).cast("int")
    rows = docs.withColumn("place", place).withColumn("ghost", ghost)
    placed = F.array_compact(F.array(F.struct("place", F.lit(False).alias("copy")), F.when(F.col("ghost").isNotNull(), F.struct(F.col("ghost").alias("place"), F.lit(True).alias("copy")))))
    rows = rows.select("doc_id", "text", F.explode(placed).alias("p")).select("p.place", "p.copy", "doc_id", "text")
    if null_head:
        # Once more after the last range with an id; without ids the null rows follow themselves.
        target = ranges[-1] if ranges else last + 1
        extra = spark.createDataFrame([(target, True, None, null_head[0]["text"])], rows.schema)
        rows = rows.union(extra)
    ordered = rows.repartition(len(cuts) + 2, "place").sortWithinPartitions(
        "place", "copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            columns = (batch.column(i) for i in range(4))
            for place, copy, doc_id, text in zip(*columns):
                place, copy, doc_id = place.as_py(), copy.as_py(), doc_id.as_py()
                text = text.as_py() or ""
                mine = sketch(text.encode())
                if held is not None and held[0] == place:
                    out.append(_compare(held[1], held[2], held[3], text, mine))
                # Of the copies of the next range, only the first is the next document.
                held = None if copy else (place, doc_id, text, mine)
            columns = list(zip(*out)) or [()] * len(OUTPUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, OUTPUT)], [n for n, _, _ in OUTPUT])

    return ordered.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind, _ in OUTPUT))


def _compare(doc_id: int | None, text: str, mine, following: str, its) -> tuple:
    cut = len(text) // 3
    edited = (text[: len(text) - cut] + following[:cut]).encode()
    changed = sketch(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited).hexdigest(), written(mine), written(changed),
        likeness(mine, changed), likeness(mine, its),
    )
