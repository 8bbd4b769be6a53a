"""MinHash near-duplicates by an inverted join of signature coordinates.

1. Each text becomes the set of its five-word shingles and a signature of ``COORDINATES`` minima.
   Equal sets are one vertex from here on, so a group of exact copies costs one row.
2. Every coordinate and its value is a posting list. Lists with one member are dropped. A link at
   the wanted similarity agrees in ``MATCHES`` of the coordinates (with a miss rate of 6e-6 at a
   similarity of exactly 0.75), so of a vertex's lists, shortest first, all but the ``MATCHES - 1``
   longest are enough to meet every partner: the long lists are skipped, and vertices with fewer
   shared lists than ``MATCHES`` drop out.
3. Members of a list are first compared with one member of it, its hub: the one whose lists are the
   longest, so the text with the fewest words of its own. That is linear, and unites groups of near
   copies whatever their size. What is left are lists with members of several components. Short ones
   meet in pairs. Members of long ones meet only where they share one of their rarest shingles, and
   so early in the order of their shingles that enough others are left to be shared.
4. Pairs that agree in ``MATCHES`` coordinates are confirmed on the full shingle sets of the whole
   texts. Components of the confirmed links are the result. A pass starts from the components of the
   one before, and one that has no pairs or confirms none ends there: it can change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.llm.components import connected_components
from bucketscore.llm.rows import mix, need, raw, slices
from bucketscore.llm.shingles import Words, shingles
from bucketscore.staging import Staged, gathered, release, stage

COORDINATES = 48
MATCHES = 23
#: Similarity in hundredths.
SIMILARITY = 75
#: Members a posting list may have for its pairs to be made by a join.
SHORT_LIST = 32

_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the smallest product with each multiplier."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingle_set), 2048):
        products = shingle_set[start : start + 2048, None] * _MULTIPLIERS[None, :]
        np.minimum(low, products.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, part in slices(texts):
        data, bounds = raw(part)
        yield from shingles(Words(data, bounds))


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, signature)`` of ``docs(doc_id, text)``; equal sets have
    equal numbers ``set_a``, ``set_b``."""
    schema = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            facts = np.zeros((3, n), dtype=np.int64)
            signs = np.zeros((n, COORDINATES), dtype=np.int32)
            for i, found in enumerate(shingle_sets(batch.column(1))):
                facts[0, i] = len(found)
                facts[1, i] = mix(found).sum(dtype=np.uint64).view(np.int64)
                facts[2, i] = mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)
                if len(found):
                    signs[i] = signature(found)
            bounds = pa.array(np.arange(n + 1, dtype=np.int32) * COORDINATES)
            lists = pa.ListArray.from_arrays(bounds, pa.array(signs.ravel()))
            columns = [batch.column(0), *map(pa.array, facts), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.mapInArrow(run, schema)


def posting_lists(vertices: DataFrame) -> DataFrame:
    """``(key, rep, members, weight)``: the lists of coordinates each vertex has to look through."""
    postings = vertices.select("rep", F.posexplode("signature").alias("pos", "value"))
    key = F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("value").cast("bigint") + F.lit(1 << 31)
    postings = postings.select("rep", key.alias("key"), F.lit(COORDINATES).cast("bigint").alias("n"))
    return shortest_lists(postings, "n", lambda n: n - (MATCHES - 1)).select("key", "rep", "members", "weight")


def shortest_lists(postings: DataFrame, total: str, needed: Callable[[Column], Column]) -> DataFrame:
    """``(rep, n, key, members, position, weight)``: of the ``total`` lists of each ``rep``, the
    ``needed`` shortest, each with the number of lists before it.

    Lists with one member come first and are not returned, so a ``rep`` with at least that many of
    them has no rows. ``weight`` is the number of members of all lists of the ``rep`` together.
    """
    crowded = postings.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    lists = postings.join(crowded, "key").groupBy("rep", F.col(total).alias("n"))
    lists = lists.agg(F.sort_array(F.collect_list(F.struct("members", "key"))).alias("lists"))
    alone = F.col("n") - F.size("lists")
    left = (needed(F.col("n")) - alone).cast("int")
    weight = F.aggregate("lists", F.lit(0).cast("bigint"), lambda total, item: total + item["members"])
    chosen = F.slice("lists", 1, F.greatest(left, F.lit(1)))
    items = lists.filter(left > 0).select("rep", "n", alone.alias("alone"), weight.alias("weight"), F.posexplode(chosen).alias("i", "item"))
    return items.select("rep", "n", "item.key", "item.members", (F.col("alone") + F.col("i")).alias("position"), "weight")


def confirm(pairs: DataFrame, vertices: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b)`` that agree in enough coordinates and are similar on full sets."""
    one = vertices.select(F.col("rep").alias("a"), F.col("signature").alias("sign_a"))
    other = vertices.select(F.col("rep").alias("b"), F.col("signature").alias("sign_b"))
    agree = F.size(F.filter(F.zip_with("sign_a", "sign_b", lambda x, y: x == y), lambda same: same))
    likely = pairs.join(other, "b").join(one, "a").filter(agree >= MATCHES).select("a", "b")
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    rows = likely.join(other, "b").join(one, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        for batch in batches:
            similar = np.zeros(batch.num_rows, dtype=bool)
            firsts = batch.column(2)
            for i, other_set in enumerate(shingle_sets(batch.column(3))):
                # Rows with one partner in common follow each other.
                text = firsts[i].as_py()
                if last_set is None or text != last_text:
                    last_text, last_set = text, next(shingle_sets(pa.array([text], pa.string())))
                common = len(np.intersect1d(last_set, other_set, assume_unique=True))
                union = len(last_set) + len(other_set) - common
                similar[i] = union > 0 and 100 * common >= SIMILARITY * union
            kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
            yield kept.filter(pa.array(similar))

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def rare_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different components among ``members(rep, component)`` that can be similar.

    For members of long lists, whose pairs would grow with the square of a group. Sets at the wanted
    similarity share one of the rarest quarter of their shingles (and one more), so only members
    that share such a shingle meet. The first shingle a link shares, in the order of rarity, leaves
    ``n - position`` of either set that can be shared; if that is too few for the similarity, the
    shingle makes no pair. So texts with a passage in common and more than a seventh of words of
    their own meet nobody, although they agree with a whole group in many coordinates.
    """
    rows = members.join(texts, "rep").select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy()
            found = list(shingle_sets(batch.column(1)))
            sizes = [len(f) for f in found]
            n = np.repeat(np.array(sizes, dtype=np.int64), sizes)
            key = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(reps, sizes)), pa.array(key), pa.array(n)], ["rep", "key", "n"]
            )

    postings = rows.mapInArrow(run, "rep bigint, key bigint, n bigint").distinct()
    shared = shortest_lists(postings, "n", lambda n: F.floor(n * (100 - SIMILARITY) / 100) + 1)
    rest = (F.col("n") - F.col("position")).alias("rest")
    shared = shared.select("key", "rep", "n", rest).join(members, "rep")
    one, other = (shared.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "rest", "component")]) for side in "ab")
    sizes_fit = 100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")
    # An intersection c of sets of n_a and n_b with 100 c >= SIMILARITY (n_a + n_b - c).
    enough = (100 + SIMILARITY) * F.least("rest_a", "rest_b") >= SIMILARITY * (F.col("n_a") + F.col("n_b"))
    meet = sizes_fit & enough & (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b"))
    return one.join(other, "key").filter(meet).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` that links reach, ``kept`` is true for that document.
    Null and empty texts have no shingles and no links. Rows that repeat a ``doc_id`` are one
    document for links, and each of them is returned. A row with a null ``doc_id`` takes no part
    in links; its component is null and it is kept. Other columns are not read.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    held: list[Staged] = []

    def keep(df: DataFrame, name: str) -> Staged:
        held.append(stage(df, name))
        return held[-1]

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = keep(signatures(docs), "signatures").df
    same = ("set_a", "set_b", "n_shingles")
    vertices = members.filter("n_shingles > 0 and doc_id is not null").groupBy(*same)
    vertices = vertices.agg(F.min(F.struct("doc_id", "signature")).alias("first"))
    vertices = keep(vertices.select(*same, F.col("first.doc_id").alias("rep"), F.col("first.signature").alias("signature")), "vertices").df

    lists = keep(posting_lists(vertices), "lists").df
    wanted = lists.select("rep").distinct()
    texts = keep(docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep"), "texts").df

    # The hub that a vertex meets in most of its lists.
    hubs = lists.groupBy("key").agg(F.min_by("rep", F.struct(-F.col("weight"), "rep")).alias("hub"))
    met = lists.join(hubs, "key").filter("hub <> rep").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("n"))
    first = met.groupBy("rep").agg(F.min(F.struct((-F.col("n")).alias("less"), "hub")).alias("best"))
    links = keep(confirm(first.select(F.col("best.hub").alias("a"), F.col("rep").alias("b")), vertices, texts), "links")
    united = keep(connected_components(gathered(links.df, links.rows)), "united")
    labelled = keep(labels(lists, united.df), "labelled").df
    # Broadcasts and shuffle files of a pass go before the next, so that the driver holds those of one pass.
    release(spark)

    # Lists whose smallest or largest member is still in another component.
    ends = labelled.groupBy("key").agg(
        F.min(F.struct("rep", "component")).alias("low"), F.max(F.struct("rep", "component")).alias("high")
    )
    meet = labelled.join(ends, "key").select("rep", "component", F.explode(F.array("low", "high")).alias("hub"))
    meet = meet.filter("hub.component <> component")
    meet = meet.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
    links = keep(confirm(meet, vertices, texts), "links")
    if links.rows:
        united = keep(connected_components(_grown(united, links)), "united")
        labelled = keep(labels(lists, united.df), "labelled").df
    release(spark)

    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    is_short = F.col("members") <= SHORT_LIST
    open_lists = stage(labelled.join(mixed.select("key"), "key", "left_semi"), "open", short=F.count_if(is_short))
    held.append(open_lists)
    pairs = []
    if open_lists.facts["short"]:
        short = open_lists.df.filter(is_short)
        one = short.select("key", F.col("rep").alias("a"), F.col("component").alias("component_a"))
        other = short.select("key", F.col("rep").alias("b"), F.col("component").alias("component_b"))
        pairs.append(one.join(other, "key").filter("a < b and component_a <> component_b").select("a", "b").distinct())
    if open_lists.facts["short"] < open_lists.rows:
        pairs.append(rare_pairs(open_lists.df.filter(~is_short).select("rep", "component").distinct(), texts))
    if pairs:
        # One job for the pairs and one for their confirmation, so that neither's broadcasts are held for both.
        pairs = keep(reduce(DataFrame.union, pairs).distinct(), "pairs")
        release(spark)
    if pairs and pairs.rows:
        links = keep(confirm(pairs.df, vertices, texts), "links")
        if links.rows:
            united = keep(connected_components(_grown(united, links)), "united")
        release(spark)

    class_of = labels(vertices.select(*same, "rep"), united.df).select(*same, "component")
    result = members.select("doc_id", *same).join(class_of, [*same], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = keep(result.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")), "result")
    release(spark, *held[:-1])
    return result.df


def _grown(united: Staged, links: Staged) -> DataFrame:
    """``links`` and the edges that unite what ``united(node, component)`` says: no more than its nodes, and flat already."""
    stars = united.df.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return gathered(stars.union(links.df), united.rows + links.rows)


def labels(rows: DataFrame, united: DataFrame) -> DataFrame:
    """``rows`` with the component of ``rep``; a vertex without links is its own."""
    known = united.select(F.col("node").alias("rep"), "component")
    return rows.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
