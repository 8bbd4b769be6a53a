"""All links between texts whose sets of five-word shingles overlap enough, as a blocked sparse product.

The incidence matrix has a row per different shingle set and a column per shingle; two rows link if
their product, the overlap c, has ``100 c >= SIMILARITY (n_a + n_b - c)``. From that follow bounds on
sizes: linked rows differ in size by at most the similarity, and a row of n columns shares at least
``least(n)`` of them with each partner.

1. Blocks of the first columns of each row, in order of their hash, are dealt by column. A block says
   how many columns each row shares with any row of a fitting size. Linked rows share at least
   a tenth of ``least(n)`` of those columns, so rows with fewer have no link and are done. Columns that several
   rows of one batch share are settled there and travel once, however common they are. Counts go back
   per batch, so there are as many as texts.
2. The other rows are looked at in full. Columns no other row has can be left out of products, and
   rows with fewer than ``least(n)`` other columns drop out. The rest are ordered from the rarest
   column to the most common; linked rows meet in one of the first ``n - least(n) + 1`` places.
3. Rows are multiplied with one row of each column first, the one with the fewest columns of its own;
   then with a row of the smallest and of the largest component that a column still holds. Both are
   linear, whatever the size of a group. Columns whose rows are all united need nothing more.
4. In what is left, a row at place i of a column can only meet sizes up to ``reach(n, i)``. The bound
   and the size classes are part of the join key, so that rows that can meet nobody make no pairs.
5. Products are taken in blocks of columns, rarest first. Overlaps are added up block by block, and a
   pair is discarded as soon as what is left cannot bring it over its bound. The components of the
   linked pairs are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.llm.components import connected_components
from bucketscore.llm.rows import mix, need, raw, slices
from bucketscore.llm.shingles import Words, shingles
from bucketscore.staging import Staged, drop, stage

#: Smallest similarity of a link, in hundredths.
SIMILARITY = 80
#: Texts for each block of columns.
TEXTS_PER_BLOCK = 4096
#: Columns that a task gathers before it passes them on.
BATCH_COLUMNS = 1 << 20
#: Columns of a row that a product takes at a time.
STEP = 64
#: Ratio of neighbouring size classes, and how many classes apart linked rows can be.
CLASS = 1.05
CLASSES_APART = math.floor(math.log(100 / SIMILARITY) / math.log(CLASS)) + 1

_SETS = ("set_a", "set_b", "n_shingles")


def least(n):
    """Columns that a row of ``n`` shares with any partner, for numbers and arrays."""
    return (SIMILARITY * n + 99) // 100


def dealt(n):
    """How many of the first columns of a row of ``n`` go into the blocks: k(n), a tenth of n, more than
    are needed to meet a partner once. So linked rows share the smaller k of them."""
    return np.minimum(n, n - least(n) + np.maximum(1, n // 10))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(CLASS)).astype(np.int64)


def set_numbers(shingle_set: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that equal sets share."""
    one = mix(shingle_set).sum(dtype=np.uint64)
    two = mix(shingle_set ^ np.uint64(0xC3C3C3C3C3C3C3C3)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, part in slices(texts):
        yield from shingles(Words(*raw(part)))


def _members(docs: DataFrame) -> DataFrame:
    """``(doc_id, set_a, set_b, n_shingles)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [(*set_numbers(s), len(s)) for s in shingle_sets(batch.column(1))]
            columns = np.array(facts, dtype=np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *_SETS])

    return docs.mapInArrow(run, "doc_id bigint, set_a bigint, set_b bigint, n_shingles bigint")


def _column_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """The first columns of all rows, cut into ``blocks`` by a hash of the column.

    A row of the result holds the columns of one batch of texts that fall into a block, with the
    size class and the text that has it, -1 if several of the batch do. One row per batch holds how
    many columns each text shares inside the batch.
    """
    names = ["block", "batch", "columns", "classes", "owners", "ids", "sets", "hits"]

    def pack(ids: list, found: list[np.ndarray], batch: int) -> Iterator[pa.RecordBatch]:
        # Equal sets are one row.
        first: dict[int, int] = {}
        for i, shingle_set in enumerate(found):
            if len(shingle_set) and ids[i] is not None:
                first.setdefault(set_numbers(shingle_set)[0], i)
        if not first:
            return
        at = list(first.values())
        doc_ids, sets = np.array([ids[i] for i in at], dtype=np.int64), np.array(list(first), dtype=np.int64)
        n = np.array([len(found[i]) for i in at], dtype=np.int64)
        counts = dealt(n)
        columns = np.concatenate([found[i][:k] for i, k in zip(at, counts)])
        owners = np.repeat(np.arange(len(at)), counts)
        classes = size_class(n)[owners]
        order = np.lexsort((classes, columns))
        columns, owners, classes = columns[order], owners[order], classes[order]
        start = np.flatnonzero(np.append(True, (columns[1:] != columns[:-1]) | (classes[1:] != classes[:-1])))
        sizes = np.diff(np.append(start, len(columns)))
        several = sizes > 1
        hits = np.bincount(owners[np.repeat(several, sizes)], minlength=len(at))
        columns, classes, owners = columns[start], classes[start], np.where(several, -1, owners[start])
        block = (mix(columns) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        block, columns, classes, owners = block[order], columns[order], classes[order], owners[order]
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        rows: list[list] = [[] for _ in names]
        for begin, end in zip(cuts, np.append(cuts[1:], len(block))):
            own = owners[begin:end]
            present = np.unique(own[own >= 0])
            place = np.where(own >= 0, np.searchsorted(present, own), -1)
            values = (columns[begin:end], classes[begin:end].astype(np.int16), place.astype(np.int32), doc_ids[present], sets[present])
            for column, value in zip(rows, [int(block[begin]), batch, *(v.tobytes() for v in values), b""]):
                column.append(value)
        for column, value in zip(rows, [batch % blocks, batch, b"", b"", b"", doc_ids.tobytes(), sets.tobytes(), hits.astype(np.int64).tobytes()]):
            column.append(value)
        numbers = [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64())]
        yield pa.RecordBatch.from_arrays([*numbers, *(pa.array(r, pa.binary()) for r in rows[2:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, waiting, number = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, shingle_set in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                ids.append(doc_id)
                found.append(shingle_set)
                waiting += len(shingle_set)
                if waiting >= BATCH_COLUMNS:
                    yield from pack(ids, found, number)
                    ids, found, waiting, number = [], [], 0, number + 1
        yield from pack(ids, found, number)

    return docs.mapInArrow(run, "block int, batch bigint, columns binary, classes binary, owners binary, ids binary, sets binary, hits binary")


def _shared_in_block(table: pa.Table) -> pa.Table:
    """``(batch, ids, hits)``: the columns of a block that each text shares with one of a fitting size."""
    columns, classes, sets, ids, many, batches, sizes = [], [], [], [], [], [], []
    out: list[tuple[int, bytes, bytes]] = []
    for _, batch, c, k, o, i, s, h in zip(*(table.column(j).to_pylist() for j in range(8))):
        if h:
            out.append((batch, i, h))
            continue
        owner = np.frombuffer(o, np.int32)
        columns.append(np.frombuffer(c, np.uint64))
        classes.append(np.frombuffer(k, np.int16))
        many.append(owner < 0)
        sets.append(np.append(np.frombuffer(s, np.int64), 0)[owner])
        ids.append(np.append(np.frombuffer(i, np.int64), 0)[owner])
        batches.append(batch)
        sizes.append(len(owner))
    if columns:
        columns, classes, sets, many = (np.concatenate(x) for x in (columns, classes, sets, many))
        order = np.lexsort((sets, classes, columns))
        columns, classes, sets = (x[order] for x in (columns, classes, sets))
        same_column = np.append(False, columns[1:] == columns[:-1])
        same_class = same_column & np.append(False, classes[1:] == classes[:-1])
        other_set = same_class & np.append(False, sets[1:] != sets[:-1])
        start = np.flatnonzero(~same_class)
        shared = np.add.reduceat((other_set | many[order]).astype(np.int64), start) > 0
        # A neighbouring class of the same column.
        near = np.append(False, (columns[start][1:] == columns[start][:-1]) & (np.diff(classes[start]) <= CLASSES_APART))
        shared |= near | np.append(near[1:], False)
        each = np.empty(len(order), dtype=bool)
        each[order] = np.repeat(shared, np.diff(np.append(start, len(columns))))
        each &= ~many
        # Back to the batches that the columns came from.
        for batch, own, mine in zip(batches, ids, np.split(each, np.cumsum(sizes)[:-1])):
            found, hits = np.unique(own[mine], return_counts=True)
            if len(found):
                out.append((batch, found.tobytes(), hits.astype(np.int64).tobytes()))
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("batch", "ids", "hits"), list(zip(*out)) or [[], [], []], kinds)})


def _sum_hits(table: pa.Table) -> pa.Table:
    """``(doc_id, hits)`` of the texts of one batch, over all blocks."""
    ids, hits = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("ids", "hits"))
    found, place = np.unique(ids, return_inverse=True)
    return pa.table({"doc_id": found, "hits": np.bincount(place, weights=hits, minlength=len(found)).astype(np.int64)})


def _rows(texts: DataFrame) -> DataFrame:
    """``(v, n, columns)`` of ``texts(v, set_a, text)``; other texts of the same document are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, kept, lists = batch.column(1).to_pylist(), [], []
            for i, shingle_set in enumerate(shingle_sets(batch.column(2))):
                if set_numbers(shingle_set)[0] == wanted[i]:
                    kept.append(i)
                    lists.append(shingle_set.view(np.int64))
                if len(kept) and (i + 1 == batch.num_rows or sum(map(len, lists[-8:])) > BATCH_COLUMNS):
                    yield part(batch, kept, lists)
                    kept, lists = [], []
            if kept:
                yield part(batch, kept, lists)

    def part(batch: pa.RecordBatch, kept: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
        columns = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(lists)))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(sizes), columns], ["v", "n", "columns"])

    return texts.select("v", "set_a", "text").mapInArrow(run, "v bigint, n bigint, columns array<bigint>")


def _ordered(rows: DataFrame) -> DataFrame:
    """``(v, n, own, columns)``: of rows that can link, the columns others have too, rarest first."""
    postings = rows.select("v", "n", F.explode("columns").alias("key"))
    common = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = postings.join(common, "key").groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("shared"))
    lists = lists.filter(100 * F.size("shared") >= SIMILARITY * F.col("n"))
    return lists.select("v", "n", (F.col("n") - F.size("shared")).alias("own"), F.transform("shared", lambda x: x["key"]).alias("columns"))


def product(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of rows that link, by their overlap in blocks of columns."""
    one, other = (rows.select(F.col("v").alias(s), F.col("n").alias(f"n_{s}"), F.col("columns").alias(f"columns_{s}")) for s in "ab")
    both = pairs.select("a", "b").join(other, "b").join(one, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                linked = _overlap(*(batch.column(i) for i in (0, 2, 3, 4, 5)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked))

    return both.select("a", "b", "n_a", "n_b", "columns_a", "columns_b").mapInArrow(run, "a bigint, b bigint")


def _overlap(a: pa.Array, n_a: pa.Array, n_b: pa.Array, columns_a: pa.ListArray, columns_b: pa.ListArray) -> np.ndarray:
    """Which pairs of a block link. Rows ``a`` are a sparse block over the columns they have."""
    _, first, row = np.unique(a.to_numpy(), return_index=True, return_inverse=True)
    lists = columns_a.take(pa.array(first))
    codes, inverse = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(len(first)), np.diff(lists.offsets.to_numpy()))
    filled = np.sort(owner * np.int64(len(codes) + 1) + inverse)
    bounds, others = columns_b.offsets.to_numpy().astype(np.int64), columns_b.values.to_numpy()
    start, size = bounds[:-1], np.diff(bounds)
    # c with 100 c >= SIMILARITY (n_a + n_b - c).
    wanted = -(-SIMILARITY * (n_a.to_numpy() + n_b.to_numpy()) // (100 + SIMILARITY))
    total = np.zeros(len(row), dtype=np.int64)
    alive, done = np.flatnonzero(size >= wanted), 0
    while len(alive):
        take = np.minimum(size[alive] - done, STEP)
        alive, take = alive[take > 0], take[take > 0]
        if not len(alive):
            break
        pair = np.repeat(np.arange(len(alive)), take)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(take) - take, take)
        value = others[start[alive][pair] + done + within]
        code = np.minimum(np.searchsorted(codes, value), len(codes) - 1)
        cell = row[alive][pair] * np.int64(len(codes) + 1) + code
        place = np.minimum(np.searchsorted(filled, cell), len(filled) - 1)
        met = (codes[code] == value) & (filled[place] == cell)
        total[alive] += np.bincount(pair[met], minlength=len(alive))
        done += STEP
        alive = alive[total[alive] + np.maximum(size[alive] - done, 0) >= wanted[alive]]
    return total >= wanted


def _fits(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _reach(n: Column, place: Column) -> Column:
    """The largest row that a row of ``n`` can link with if their first common column is at ``place``.

    The overlap is at most ``n - place`` and at least SIMILARITY / (100 + SIMILARITY) of both sizes.
    """
    return F.floor(((100 + SIMILARITY) * (n - place) - SIMILARITY * n) / SIMILARITY)


def _class(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(CLASS))


def _remaining(places: DataFrame) -> DataFrame:
    """Pairs of different components that may link, among ``places(key, v, n, place, component)``.

    The larger row asks for the size classes it can meet there; the smaller one, by its id among
    equals, stands in its own class unless its place rules out rows of its own size.
    """
    reach = _reach(F.col("n"), F.col("place"))
    top = F.least(reach, F.col("n"))
    bottom = F.ceil(F.col("n") * SIMILARITY / 100)
    asks = places.select("*", reach.alias("reach"), top.alias("top"), bottom.alias("bottom")).filter("top >= bottom")
    asks = asks.withColumn("class", F.explode(F.sequence(_class(F.col("bottom")), _class(F.col("top")))))
    asks = asks.select("key", "class", *[F.col(c).alias(f"{c}_a") for c in ("v", "n", "reach", "component")])
    stands = places.select("*", reach.alias("reach"), _class(F.col("n")).alias("class")).filter("reach >= n")
    stands = stands.select("key", "class", *[F.col(c).alias(f"{c}_b") for c in ("v", "n", "reach", "component")])
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("v_a") > F.col("v_b")))
    meet = larger & (F.col("component_a") != F.col("component_b")) & (F.col("n_b") <= F.col("reach_a")) & (F.col("n_a") <= F.col("reach_b"))
    pairs = asks.join(stands, ["key", "class"]).filter(meet & _fits(F.col("n_a"), F.col("n_b")))
    return pairs.select(F.col("v_a").alias("a"), F.col("v_b").alias("b")).distinct()


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` that links reach, ``n_shingles`` the size of the set.
    Null and empty texts have an empty set and no links. Rows that repeat a ``doc_id`` are one
    document for links, and each of them is returned. A row with a null ``doc_id`` takes no part in
    links, and its component is null. Other columns are not read. Texts are compared by 64-bit hashes
    of shingles and sets.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    held: list[Staged] = []

    def keep(df: DataFrame, name: str) -> Staged:
        held.append(stage(df, name))
        return held[-1]

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = keep(_members(docs), "members")
    blocks = -(-members.rows // TEXTS_PER_BLOCK) or 1
    members = members.df
    known = members.filter("n_shingles > 0 and doc_id is not null").withColumn("v", F.xxhash64(*_SETS))
    vertices = keep(known.groupBy("v", *_SETS).agg(F.min("doc_id").alias("rep")), "vertices").df

    hits = _column_blocks(docs, blocks).groupBy("block").applyInArrow(_shared_in_block, "batch bigint, ids binary, hits binary")
    hits = hits.groupBy("batch").applyInArrow(_sum_hits, "doc_id bigint, hits bigint")
    # A partner has at least ``least(n)`` columns, and shares the smaller k of both.
    enough = F.col("hits") >= F.greatest(F.lit(1), F.floor(F.ceil(F.col("n_shingles") * SIMILARITY / 100) / 10))
    likely = known.join(hits, "doc_id").filter(enough).select("v").distinct()
    chosen = vertices.join(likely, "v").select(F.col("rep").alias("doc_id"), "v", "set_a")
    rows = keep(_rows(docs.join(chosen, "doc_id")), "rows")
    repeated = rows.rows > rows.df.select("v").distinct().count()
    rows = rows.df.dropDuplicates(["v"]) if repeated else rows.df
    rows = keep(_ordered(rows), "ordered").df

    prefix = F.slice("columns", 1, (F.size("columns") - F.ceil(F.col("n") * SIMILARITY / 100) + 1).cast("int"))
    places = rows.select("v", "n", "own", F.posexplode(prefix).alias("i", "key")).withColumn("place", F.col("own") + F.col("i"))
    several = places.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min_by("v", F.struct(F.col("own") / F.col("n"), "v")).alias("hub"))
    places = keep(places.join(several.filter("members > 1"), "key").select("key", "v", "n", "place", "hub"), "places").df

    # The row with the fewest columns of its own that a row meets most often.
    sizes = rows.select(F.col("v").alias("hub"), F.col("n").alias("n_hub"))
    met = places.filter("hub <> v").groupBy("v", "n", "hub").agg(F.count(F.lit(1)).alias("times"))
    met = met.join(sizes, "hub").filter(_fits(F.col("n"), F.col("n_hub")))
    first = met.groupBy("v").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
    links = keep(product(first.select(F.col("hub").alias("a"), F.col("v").alias("b")), rows), "links").df
    united = keep(connected_components(links), "united").df

    labelled = keep(_labels(places, united), "labelled").df
    ends = labelled.groupBy("key").agg(F.min(F.struct("component", "n", "v")).alias("low"), F.max(F.struct("component", "n", "v")).alias("high"))
    ends = ends.filter("low.component <> high.component")
    meet = labelled.join(ends, "key").select("v", "n", "component", F.explode(F.array("low", "high")).alias("end"))
    meet = meet.filter(F.col("end.component") != F.col("component")).filter(_fits(F.col("n"), F.col("end.n")))
    meet = meet.select(F.least("v", "end.v").alias("a"), F.greatest("v", "end.v").alias("b")).distinct()
    links = keep(links.union(product(meet, rows)), "links").df
    united = keep(connected_components(links), "united").df

    labelled = _labels(places, united)
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    left = keep(labelled.join(mixed.select("key"), "key", "left_semi"), "left").df
    links = keep(links.union(product(_remaining(left), rows)), "links").df

    # Documents: sets that link, and sets of rows that repeat a doc_id.
    reps = vertices.select("v", "rep")
    edges = links.join(reps.select(F.col("v").alias("a"), F.col("rep").alias("x")), "a")
    edges = edges.join(reps.select(F.col("v").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    twins = known.groupBy("doc_id").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low <> high").select("doc_id")
    twins = known.join(twins, "doc_id", "left_semi").join(reps, "v").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    united = keep(connected_components(edges.unionByName(twins)), "united").df
    named = reps.join(united.select(F.col("node").alias("rep"), "component"), "rep", "left").select("v", F.coalesce("component", "rep").alias("component"))
    result = members.withColumn("v", F.when(F.col("n_shingles") > 0, F.xxhash64(*_SETS))).join(named, "v", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = stage(result.select("doc_id", "n_shingles", component.alias("component_id")), "result").df
    drop(spark, *held)
    return result


def _labels(places: DataFrame, united: DataFrame) -> DataFrame:
    known = united.select(F.col("node").alias("v"), "component")
    rows = places.join(known, "v", "left")
    return rows.withColumn("component", F.coalesce("component", "v"))
