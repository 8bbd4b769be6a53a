"""One-hot encoding of leading categorical features, sparse all the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketscore.functions.running import running_totals
from bucketscore.staging import Staged, broadcast_limit, row_bytes, stage

#: A value with more than this share of the rows is split over ``SALTS`` keys of a shuffled lookup.
HOT_SHARE = 1 / 200
SALTS = 32


@dataclass(frozen=True)
class Categories:
    """The dictionary as a table ``(pos, value, rows, slot)``, one row per category value.

    Slots are numbered by position, then value. ``sizes`` has the number of values of each position.
    """

    table: Staged
    sizes: tuple[int, ...]
    rows: int

    @property
    def width(self) -> int:
        return sum(self.sizes)


def categories(df: DataFrame, first_numeric: int, features: str = "features") -> DataFrame:
    """``(pos, value, rows)``: the values of the leading features, truncated to whole numbers."""
    leading = F.slice(features, 1, first_numeric)
    values = df.select(F.posexplode(leading).alias("pos", "x")).select("pos", F.col("x").cast("int").alias("value"))
    return values.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("rows"))


def category_dictionary(df: DataFrame, first_numeric: int, features: str = "features") -> DataFrame:
    """``(pos, cats)`` with the sorted values of each categorical feature, as one list per feature.

    For reading. ``fit_one_hot`` gives the same as a table, for any number of values.
    """
    found = categories(df, first_numeric, features)
    return found.groupBy("pos").agg(F.array_sort(F.collect_set("value")).alias("cats"))


def fit_one_hot(df: DataFrame, first_numeric: int, features: str = "features") -> Categories:
    """Count the category values, and number them without bringing them to one task or the driver."""
    found = categories(df, first_numeric, features).filter("value is not null").withColumn("one", F.lit(1))
    ranked = stage(running_totals(found, "value", ["one"], ["pos"]), "categories").df
    per_feature = {r.pos: r for r in ranked.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).collect()}
    sizes = tuple(per_feature[pos].n if pos in per_feature else 0 for pos in range(first_numeric))
    before = F.array(*[F.lit(sum(sizes[:pos])).cast("bigint") for pos in range(first_numeric)])
    slot = (F.get(before, F.col("pos")) + F.col("upto_one") - 1).cast("int")
    table = stage(ranked.select("pos", "value", "rows", slot.alias("slot")), "slots")
    return Categories(table, sizes, max([0, *(r.rows for r in per_feature.values())]))


def _look_up(df: DataFrame, known: Categories, pos: int, code: str, slot: str) -> DataFrame:
    """``df`` with the slot of the value ``code`` of feature ``pos``, null if it is unknown.

    A short dictionary is broadcast. Otherwise rows are shuffled by value; values that many rows have
    are dealt over several copies of their dictionary row. At most ``1 / HOT_SHARE`` values are that hot.
    """
    table = known.table.df.filter(F.col("pos") == pos)
    names = table.select(F.col("value").alias(code), F.col("slot").alias(slot), "rows")
    if known.sizes[pos] * row_bytes(names.schema) <= broadcast_limit(df.sparkSession):
        return df.join(F.broadcast(names.drop("rows")), code, "left")
    is_hot = F.col("rows") > known.rows * HOT_SHARE
    hot = names.filter(is_hot).select(code, F.lit(True).alias("_hot"))
    # Any salt finds the same row, so it does not matter that a row's number may change.
    number = F.monotonically_increasing_id() % SALTS
    dealt = df.withColumn("_number", number).join(F.broadcast(hot), code, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot"), F.col("_number")).otherwise(0)).drop("_hot", "_number")
    copies = F.sequence(F.lit(0).cast("bigint"), F.when(is_hot, F.lit(SALTS - 1)).otherwise(0).cast("bigint"))
    salted = names.withColumn("_salt", F.explode(copies)).drop("rows")
    return dealt.join(salted.hint("merge"), [code, "_salt"], "left").drop("_salt")


def one_hot(
    df: DataFrame,
    known: Categories,
    features: str = "features",
    handle_invalid: str = "error",
    form: str = "sparse",
) -> DataFrame:
    """Replace each leading categorical feature by the slot of its value, and keep the numeric rest.

    ``form="sparse"`` gives a struct ``(type, size, indices, values)``, as Spark ML stores a sparse
    vector; ``"vector"`` writes that and reads it back as a vector column; ``"array"`` gives all slots,
    for dictionaries that are as narrow as that. An unknown value or null is an error, or has no slot
    with ``handle_invalid="zero"``.
    """
    if handle_invalid not in ("error", "zero"):
        raise ValueError("handle_invalid is 'error' or 'zero'")
    if form not in ("sparse", "vector", "array"):
        raise ValueError("form is 'sparse', 'vector' or 'array'")
    count = len(known.sizes)
    codes, slots = [f"_code{i}" for i in range(count)], [f"_slot{i}" for i in range(count)]
    rows = df
    for i in range(count):
        rows = _look_up(rows.withColumn(codes[i], F.get(features, F.lit(i)).cast("int")), known, i, codes[i], slots[i])
    found = []
    for i in range(count):
        slot = F.col(slots[i])
        if handle_invalid == "error":
            message = F.concat(F.lit(f"unknown category in feature {i}: "), F.coalesce(F.col(codes[i]).cast("string"), F.lit("null")))
            slot = F.coalesce(slot, F.raise_error(message).cast("int"))
        found.append(slot)
    ones = F.filter(F.array(*found).cast("array<int>"), lambda s: s.isNotNull())
    rest = F.greatest(F.size(features) - count, F.lit(0))
    tail = F.slice(features, count + 1, rest)
    places = F.transform(tail, lambda _, i: (i + known.width).cast("int"))
    row = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        (rest + known.width).cast("int").alias("size"),
        F.concat(ones, places).alias("indices"),
        F.concat(F.transform(ones, lambda _: F.lit(1.0)), tail).alias("values"),
    )
    encoded = rows.withColumn(features, row).select(*df.columns)
    if form == "vector":
        return _as_vectors(encoded, features)
    return encoded.withColumn(features, _all_slots(F.col(features))) if form == "array" else encoded


def _as_vectors(df: DataFrame, features: str) -> DataFrame:
    """The sparse structs of ``features`` as vectors: the file of one is that of the other."""
    table = stage(df, "sparse")
    fields = [T.StructField(f.name, VectorUDT() if f.name == features else f.dataType) for f in df.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(table.path)


def _all_slots(row: Column) -> Column:
    value = lambda i: F.try_element_at(row["values"], F.array_position(row["indices"], i).cast("int"))
    has = lambda i: F.array_contains(row["indices"], i)
    return F.transform(F.sequence(F.lit(0), row["size"] - 1), lambda i: F.when(has(i), value(i)).otherwise(0.0))
