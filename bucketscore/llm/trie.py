"""The prefix trie of conversations, in double arrays per shard.

A node is a distinct sequence of the first d turns of some conversation. A node's key is the
exclusive or of one 128-bit digest per turn and position, so keys of prefixes can be summed up in any
order and on any executor; two different prefixes share a key with probability 2^-128.

1. Conversations are cut into segments of ``LEVELS`` turns. Equal segments below the same node
   become one row with a count, so copies of a conversation cost one row.
2. Segments are ordered by where they start and by their turns, and cut into ranges: the shards. A
   shard packs its segments into a double array, ``BASE`` and ``CHECK`` over dense turn ids of its
   own, and walks them through it. Ranges of an ordered trie overlap only in the nodes above a
   shard's first and last segment, however common a prefix is.
3. All other nodes are complete in their shard, with the sums of their subtrees. The shared upper
   nodes' parts are merged globally, and what hangs below them is added up.
4. Segments that go on are done first; what their start gathers is carried to the end of the segment
   before. There are as many rounds as the longest conversation has segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscore.llm.rows import need
from bucketscore.staging import Staged, drop, stage

#: Turns of a segment.
LEVELS = 512
#: Turns that are packed into one double array.
SHARD_TURNS = 1 << 17
#: A parent with at least this share of all nodes below it is joined by a broadcast; there are at most as many.
HEAVY = 200
#: Characters of one piece of a list of ids.
PIECE = 1 << 16


def turn_rows(conversations: DataFrame, held: list[Staged]) -> DataFrame:
    """``(conv_id, position, t1, t2, n_bytes)``: the turns of ``conversations(conv_id, turn, role, text)``.

    ``position`` counts from 0 in order of ``turn``, null first; equal turns go by a digest of role
    and text. ``t1, t2`` is that digest, ``n_bytes`` the text's length in UTF-8. A null role or text
    is empty. Rows with a null ``conv_id`` belong to no conversation and are left out. A conversation
    may hold any share of all rows: rows are dealt by ranges and counted across them. The table that
    the rows are read from is added to ``held``, for the caller to drop.
    """
    need(conversations, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    order = ("turn", "t1", "t2")
    held.append(stage(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns"))
    ranged = held[-1].df
    # Only the first and the last conversation of a range can lie in several; two rows a range.
    ends = ranged.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    torn = ends.select(F.explode(F.array("low", "high")).alias("conv_id"), "part").distinct()
    torn = torn.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("conv_id")
    counts = ranged.join(F.broadcast(torn), "conv_id").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))
    numbered = ranged.withColumn("inside", inside).join(F.broadcast(offsets), ["conv_id", "part"], "left")
    position = (F.col("inside") - 1 + F.coalesce("offset", F.lit(0))).cast("bigint")
    return numbered.select("conv_id", position.alias("position"), "t1", "t2", "n_bytes")


def conversation_trie(conversations: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``prefix_nodes`` of ``conversations(conv_id, turn, role, text)``.

    ``change`` may turn the rows of ``turn_rows`` into others of the same columns, for example into
    conversations put together anew. Other columns are not read.
    """
    held: list[Staged] = []
    rows = turn_rows(conversations, held)
    nodes = prefix_nodes(change(rows) if change else rows)
    drop(conversations.sparkSession, *held)
    return nodes


def share_beginnings(rows: DataFrame) -> DataFrame:
    """Conversations whose beginning is another's: ``c`` takes the first h turns of ``c - c % 5``.

    With h the crc32 of the id modulo 9, that many turns of that conversation (all if it has fewer,
    none if it does not exist) stand before its own turns after its first h. A conversation that ends
    up without turns has one row with a null ``position``.
    """
    lengths = rows.groupBy("conv_id").agg(F.count("position").alias("length"))
    own_h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 9
    wanted = lengths.select("conv_id", "length", own_h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("giver"))
    givers = lengths.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("giver"), F.col("length").alias("given"))
    wanted = wanted.join(givers, "giver", "left")
    wanted = wanted.withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    turn = ("t1", "t2", "n_bytes")
    own = rows.join(wanted.select("conv_id", "h", "taken"), "conv_id").filter("position >= h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), *turn)
    first = rows.filter("position < 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "giver")
    first = first.join(wanted.select("giver", "conv_id", "h"), "giver").filter("position < h").select("conv_id", "position", *turn)
    bare = wanted.filter("taken = 0 and length <= h").select("conv_id", *[F.lit(None).cast("bigint").alias(c) for c in ("position", *turn)])
    return own.unionByName(first).unionByName(bare)


def prefix_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``rows(conv_id, position, t1, t2, n_bytes)``.

    Positions of a conversation count from 0 without gaps; one row with a null position stands for a
    conversation without turns. Per node: ``conv_id``, its smallest member; ``depth``;
    ``parent_conv_id``, null for the root; ``n_convs``, its members; ``n_children``; ``n_leaves``,
    childless nodes in its subtree; ``saved_tokens``, the sum over its subtree of
    ``(n_convs - 1) * n_bytes``; ``ends_sha256``, the digest of the ids of members that end here,
    ascending and joined by commas; and ``t1, t2``, the digest of its last turn. Subtrees include
    their top. Without conversations there are no nodes, not even the root. Repeated conversations
    are members each; repeated rows of one turn number are turns each.
    """
    spark = rows.sparkSession
    held: list[Staged] = []

    def keep(df: DataFrame, name: str, **facts: Column) -> Staged:
        held.append(stage(df, name, **facts))
        return held[-1]

    segments = keep(_segments(rows), "segments", last=F.max("seg"))
    if not segments.rows:
        drop(spark, *held)
        return spark.createDataFrame([], _RESULT)
    last = segments.facts["last"]
    placed = keep(_placed(segments.df), "placed").df if last else _placed_once(segments.df)
    distinct = placed.groupBy("seg", "s1", "s2", "x1", "x2").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("items").alias("items")
    )
    distinct = keep(distinct, "distinct").df

    levels, carried = [], None
    for seg in range(last, -1, -1):
        parts = keep(_shards(distinct.filter(F.col("seg") == seg).drop("seg"), carried, seg), "shards").df
        upper = keep(_upper(parts.filter("upper")), "upper").df
        top = seg * LEVELS
        if seg:
            carried = upper.filter(F.col("depth") == top)
            upper = upper.filter(F.col("depth") > top)
        levels.append(parts.filter("not upper").select(*_NODE).unionByName(upper.select(*_NODE)))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = keep(nodes, "nodes")
    ends = placed.filter("ends").select(
        "conv_id",
        (F.col("seg") * LEVELS + F.size("items")).cast("bigint").alias("depth"),
        F.col("s1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("s2").bitwiseXOR(F.col("x2")).alias("p2"),
    )
    result = _parents(nodes).join(ends_digests(ends), ["depth", "p1", "p2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    result = result.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    result = stage(result.select(*[f.split()[0] for f in _RESULT.split(", ")]), "trie").df
    drop(spark, *held)
    return result


_RESULT = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, t1 bigint, t2 bigint"
)
_KEY = ("depth", "p1", "p2")
_NODE = (*_KEY, "q1", "q2", "t1", "t2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id", "upper")


def _segments(rows: DataFrame) -> DataFrame:
    """``(conv_id, seg, items, x1, x2)``: up to ``LEVELS`` turns each, and the key they add."""
    rows = rows.withColumns(
        {"z1": F.xxhash64("position", "t1", "t2"), "z2": F.xxhash64("t2", "position", "t1")}
    )
    item = F.when(F.col("position").isNotNull(), F.struct("position", "t1", "t2", "n_bytes", "z1", "z2"))
    seg = F.floor(F.coalesce("position", F.lit(0)) / LEVELS).cast("int").alias("seg")
    there = F.col("position").isNotNull()
    return rows.groupBy("conv_id", seg).agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        *[F.coalesce(F.bit_xor(F.when(there, F.col(f"z{i}"))), F.lit(0).cast("bigint")).alias(f"x{i}") for i in (1, 2)],
    )


def _placed_once(segments: DataFrame) -> DataFrame:
    """As ``_placed`` where no conversation has a second segment."""
    zero = F.lit(0).cast("bigint")
    return segments.select("*", zero.alias("s1"), zero.alias("s2"), F.lit(True).alias("ends"))


def _placed(segments: DataFrame) -> DataFrame:
    """Segments with the key ``s1, s2`` of the node they start at, and whether the conversation ends."""
    long = segments.filter("seg > 0").select("conv_id").distinct()
    many = segments.select("conv_id", "seg", "x1", "x2").join(long, "conv_id", "left_semi")
    along = Window.partitionBy("conv_id").orderBy("seg")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = many.select(
        "conv_id",
        "seg",
        *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0).cast("bigint")).alias(f"s{i}") for i in (1, 2)],
        F.lead("seg").over(along).isNull().alias("ends"),
    )
    rows = segments.join(starts, ["conv_id", "seg"], "left")
    zero = F.lit(0).cast("bigint")
    return rows.withColumns({"s1": F.coalesce("s1", zero), "s2": F.coalesce("s2", zero), "ends": F.coalesce("ends", F.lit(True))})


def _shards(segments: DataFrame, carried: DataFrame | None, seg: int) -> DataFrame:
    """The nodes that each shard finds; ``upper`` ones are parts that other shards may share."""
    if carried is None:
        none = F.lit(None).cast("bigint")
        segments = segments.select("*", none.alias("more_children"), none.alias("more_leaves"), none.alias("more_saved"))
    else:
        below = carried.select(
            F.col("p1").alias("e1"),
            F.col("p2").alias("e2"),
            F.col("n_children").alias("more_children"),
            F.col("n_leaves").alias("more_leaves"),
            F.col("saved_tokens").alias("more_saved"),
        )
        end = [F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")) == F.col(f"e{i}") for i in (1, 2)]
        segments = segments.join(below, [*end, F.size("items") == LEVELS], "left").drop("e1", "e2")
    path = F.transform("items", lambda item: F.struct(item["t1"], item["t2"]))
    ordered = segments.withColumn("path", path).repartitionByRange("s1", "s2", "path").sortWithinPartitions("s1", "s2", "path")
    columns = ("s1", "s2", "n", "conv_id", "more_children", "more_leaves", "more_saved", "items")
    top = seg * LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, turns = [], 0
        for batch in batches:
            first = 0
            sizes = np.diff(batch.column(7).offsets.to_numpy())
            while first < batch.num_rows:
                room = np.searchsorted(np.cumsum(sizes[first:]), max(SHARD_TURNS - turns, 1)) + 1
                part = batch.slice(first, int(room))
                waiting.append(part)
                turns += int(sizes[first : first + part.num_rows].sum())
                first += part.num_rows
                if turns >= SHARD_TURNS:
                    yield from _pack(pa.Table.from_batches(waiting), top)
                    waiting, turns = [], 0
        if waiting:
            yield from _pack(pa.Table.from_batches(waiting), top)

    schema = (
        "depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, t1 bigint, t2 bigint, n_bytes bigint, conv_id bigint, "
        "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, parent_conv_id bigint, upper boolean, "
        "above array<struct<p1:bigint,p2:bigint>>"
    )
    return ordered.select(*columns).mapInArrow(run, schema)


class DoubleArray:
    """States of a trie over small codes: ``check[base[s] + c] == s`` if state s has a child by c."""

    def __init__(self) -> None:
        self.base = np.zeros(1024, dtype=np.int64)
        self.check = np.full(1024, -1, dtype=np.int64)
        self.check[0] = 0
        self.low = 1

    def _reach(self, end: int) -> None:
        if end > len(self.check):
            more = max(end, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def _free(self, start: int, count: int) -> np.ndarray:
        """The first ``count`` free places from ``start`` on."""
        found, window = [], max(1024, 4 * count)
        while count > 0:
            self._reach(start + window)
            found.append(start + np.flatnonzero(self.check[start : start + window] < 0)[:count])
            count -= len(found[-1])
            start += window
        return np.concatenate(found)

    def add(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Give ``parents``, in order, their children by ``codes``, ascending within a parent."""
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        sizes = np.diff(np.append(first, len(parents)))
        for family in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            own = codes[first[family] : first[family] + sizes[family]]
            self._place(int(parents[first[family]]), own)
        single = first[sizes == 1]
        if len(single):
            places = self._free(self.low, len(single))
            self.check[places] = parents[single]
            self.base[parents[single]] = places - codes[single]
            self.low = int(places[-1]) + 1

    def _place(self, parent: int, codes: np.ndarray) -> None:
        offsets = codes - codes[0]
        start, count = self.low, 64
        while True:
            places = self._free(start, count)
            if start == self.low:
                start = self.low = int(places[0])
            self._reach(int(places[-1] + offsets[-1]) + 1)
            # A few offsets sort out most places.
            fits = places[(self.check[places[:, None] + offsets[None, 1:17]] < 0).all(axis=1)]
            for place in fits.tolist():
                if (self.check[place + offsets] < 0).all():
                    self.check[place + offsets] = parent
                    self.base[parent] = place - codes[0]
                    return
            start, count = int(places[-1]) + 1, 2 * count

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where ``codes`` lead from ``states``; -1 where there is no such child."""
        after = self.base[states] + codes
        inside = (after > 0) & (after < len(self.check))
        after = np.where(inside, after, 0)
        return np.where(inside & (self.check[after] == states), after, -1)


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... of the different rows, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for column in columns:
        ordered = column[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    codes = np.empty(len(order), dtype=np.int64)
    codes[order] = np.cumsum(new)
    return codes


def _pack(table: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """Pack the ordered segments of a shard, walk them, and yield the nodes met.

    Below state 0 hang the nodes at which segments start, below those the turns.
    """
    table = table.combine_chunks()
    if not table.num_rows:
        return
    s1, s2, n, conv = (table.column(c).to_numpy() for c in ("s1", "s2", "n", "conv_id"))
    more = {c: table.column(c).fill_null(0).to_numpy() for c in ("more_children", "more_leaves", "more_saved")}
    lists = table.column("items").chunk(0)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    items = lists.values
    t1, t2, size, z1, z2 = (items.field(c).to_numpy() for c in ("t1", "t2", "n_bytes", "z1", "z2"))
    lengths = np.diff(bounds)

    trie = DoubleArray()
    codes, starts = _dense(t1, t2), _dense(s1, s2)
    state = np.zeros(len(lengths), dtype=np.int64)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in range(int(lengths.max()) + 1):
        # Level 0 leads to where a segment starts, level d by its turn d - 1.
        going = np.flatnonzero(lengths >= level)
        code = codes[bounds[going] + level - 1] if level else starts
        before = state[going]
        new = np.append(True, (before[1:] != before[:-1]) | (code[1:] != code[:-1]))
        trie.add(before[new], code[new])
        state[going] = trie.step(before, code)
        steps.append((going, before, state[going]))

    states = len(trie.check)
    members, smallest = np.zeros(states, np.int64), np.full(states, np.iinfo(np.int64).max)
    children, leaves, saved = (np.zeros(states, np.int64) for _ in range(3))
    p1, p2, last1, last2, weight = (np.zeros(states, np.int64) for _ in range(5))
    parent, depth = np.full(states, -1, np.int64), np.zeros(states, np.int64)
    shared = np.zeros(states, dtype=bool)
    for level, (going, before, after) in enumerate(steps):
        np.add.at(members, after, n[going])
        np.minimum.at(smallest, after, conv[going])
        parent[after], depth[after] = before, top + level
        if level == 0:
            p1[after], p2[after], shared[after] = s1[going], s2[going], True
        else:
            at = bounds[going] + level - 1
            p1[after], p2[after] = p1[before] ^ z1[at], p2[before] ^ z2[at]
            last1[after], last2[after], weight[after] = t1[at], t2[at], size[at]
        for edge in (0, len(lengths) - 1):
            shared[after[going == edge]] = True
    found = [np.unique(after) for _, _, after in steps]
    for nodes in found[1:]:
        # Children that other shards may know as well are counted when they are merged.
        np.add.at(children, parent[nodes[~shared[nodes]]], 1)
    np.add.at(children, state, more["more_children"])
    np.add.at(leaves, state, more["more_leaves"])
    np.add.at(saved, state, more["more_saved"])
    for nodes in reversed(found):
        own = nodes[~shared[nodes]]
        leaves[own] += children[own] == 0
        saved[own] += (members[own] - 1) * weight[own]
        np.add.at(leaves, parent[own], leaves[own])
        np.add.at(saved, parent[own], saved[own])

    nodes = np.concatenate(found)
    above_of = parent[nodes]
    whole = ~shared[nodes]
    has_parent = depth[nodes] > top
    known = has_parent & ~shared[np.maximum(above_of, 0)]
    ancestors: list[int] = []
    ends = [0]
    for node in nodes.tolist():
        if shared[node]:
            up = int(parent[node])
            while up > 0:
                ancestors.append(up)
                up = int(parent[up])
        ends.append(len(ancestors))
    up = np.array(ancestors, dtype=np.int64)
    above = pa.ListArray.from_arrays(
        pa.array(np.array(ends, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(p1[up]), pa.array(p2[up])], ["p1", "p2"])
    )
    columns = {
        "depth": depth[nodes],
        "p1": p1[nodes],
        "p2": p2[nodes],
        "q1": pa.array(p1[above_of], mask=~has_parent),
        "q2": pa.array(p2[above_of], mask=~has_parent),
        "t1": pa.array(last1[nodes], mask=~has_parent),
        "t2": pa.array(last2[nodes], mask=~has_parent),
        "n_bytes": weight[nodes],
        "conv_id": smallest[nodes],
        "n_convs": members[nodes],
        "n_children": children[nodes],
        "n_leaves": leaves[nodes],
        "saved_tokens": saved[nodes],
        "parent_conv_id": pa.array(smallest[above_of], mask=~known),
        "upper": ~whole,
        "above": above,
    }
    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _upper(parts: DataFrame) -> DataFrame:
    """Merge the parts of nodes that several shards share, and sum up their subtrees."""
    same = ("q1", "q2", "t1", "t2", "n_bytes", "above")
    merged = parts.groupBy(*_KEY).agg(
        *[F.first(c).alias(c) for c in same],
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    kids = merged.filter("q1 is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    merged = merged.join(kids.agg(F.count(F.lit(1)).alias("kids")), [*_KEY], "left")
    merged = merged.withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    # The node that segments start at is a leaf only as the root; else it counts one segment up.
    own = (F.col("n_children") == 0).cast("bigint")
    merged = merged.withColumns(
        {"n_leaves": F.col("n_leaves") + own, "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes")}
    )
    to = F.concat(F.array(F.struct("p1", "p2")), "above")
    sums = merged.select("n_leaves", "saved_tokens", F.explode(to).alias("to")).groupBy(F.col("to.p1").alias("p1"), F.col("to.p2").alias("p2"))
    sums = sums.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    rows = merged.drop("n_leaves", "saved_tokens").join(sums, ["p1", "p2"])
    return rows.select(*[c for c in _NODE if c not in ("parent_conv_id", "upper")], F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(True).alias("upper"))


def _parents(nodes: Staged) -> DataFrame:
    """Nodes with ``parent_conv_id``, looked up where the parent is known only since the merge."""
    out = [c for c in _NODE if c not in ("q1", "q2", "upper")]
    known = nodes.df.filter("parent_conv_id is not null or depth = 0").select(*out)
    open_ = nodes.df.filter("parent_conv_id is null and depth > 0").drop("parent_conv_id", "upper")
    tops = nodes.df.filter(F.col("upper") | (F.col("depth") % LEVELS == 0))
    tops = tops.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") * HEAVY >= nodes.rows
    heavy, light = (tops.filter(c).drop("n_children") for c in (many, ~many))
    on = ["depth", "q1", "q2"]
    below_heavy = open_.join(F.broadcast(heavy), on).select(*out)
    below_light = open_.join(F.broadcast(heavy), on, "left_anti").join(light, on).select(*out)
    return known.unionByName(below_heavy).unionByName(below_light)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(depth, p1, p2, ends_sha256)``: the digest of the ids ``conv_id`` of each key, ascending.

    Ids are joined to pieces wherever they lie, then the pieces of a key follow each other through
    one digest, so a key with a third of all ids is held by nobody.
    """
    key = "depth bigint, p1 bigint, p2 bigint"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(3)]
            ids = batch.column(3).to_pylist()
            change = np.zeros(batch.num_rows, dtype=bool)
            for column in columns:
                change[1:] |= column[1:] != column[:-1]
            first = np.append(0, np.flatnonzero(change)).tolist()
            pieces: tuple[list, list] = ([], [])
            for start, stop in zip(first, [*first[1:], batch.num_rows]):
                for at in range(start, stop, PIECE // 16):
                    pieces[0].append(at)
                    pieces[1].append(",".join(map(str, ids[at : min(at + PIECE // 16, stop)])))
            rows = [pa.array(c[pieces[0]]) for c in columns] + [pa.array([ids[i] for i in pieces[0]], pa.int64()), pa.array(pieces[1], pa.string())]
            yield pa.RecordBatch.from_arrays(rows, ["depth", "p1", "p2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for *at, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if at != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = at, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield _digest_rows(done)
        if now is not None:
            yield _digest_rows([(*now, sha.hexdigest())])

    pieces = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    pieces = pieces.mapInArrow(join, f"{key}, first bigint, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["depth", "p1", "p2", "ends_sha256"])
