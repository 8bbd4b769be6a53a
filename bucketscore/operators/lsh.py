"""Random-projection hashing of points into buckets.

``code = floor((a . x/r) / w + u)`` with ``a ~ N(0, I)`` and ``u ~ U[0, 1)``, ``key_length`` codes
per table (Datar, Immorlica, Indyk, Mirrokni, SoCG 2004).

The projections are the only Python step: one matrix product per Arrow batch. The UDF keeps the
row as it is, so the table fan-out and the codes stay in generated JVM code, and columns such as
the id never cross to Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.functions.scalar import doubles


@dataclass(frozen=True)
class HashFamily:
    """Seeded hash functions. With several widths, or ``label_width``, ``w`` is part of the key.

    With ``prefixes``, so is ``length``: each key is also cut to its first codes, of which the rest is 0.
    """

    dim: int
    key_length: int
    num_tables: int
    widths: tuple[float, ...] = (4.0,)
    radius: float = 1.0
    seed: int = 7
    label_width: bool = False
    prefixes: tuple[int, ...] = ()
    stored: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False, compare=False)

    def __post_init__(self) -> None:
        if min(self.dim, self.key_length, self.num_tables) < 1:
            raise ValueError("dim, key_length and num_tables must be at least 1")
        if not self.widths or min(self.widths) <= 0 or self.radius <= 0:
            raise ValueError("widths and radius must be positive")
        if len(set(self.widths)) != len(self.widths):
            raise ValueError("widths must differ")

    @cached_property
    def _drawn(self) -> tuple[np.ndarray, np.ndarray]:
        if self.stored is not None:
            return self.stored
        rng = np.random.default_rng(self.seed)
        count = self.num_tables * self.key_length
        return rng.standard_normal((count, self.dim)), rng.random(count)

    @property
    def planes(self) -> np.ndarray:
        """One plane per row; row ``t * key_length + j`` is code ``j`` of table ``t``."""
        return self._drawn[0]

    @property
    def offsets(self) -> np.ndarray:
        return self._drawn[1]

    @property
    def sweeping(self) -> bool:
        return self.label_width or len(self.widths) > 1

    @property
    def scope(self) -> list[str]:
        """Columns that separate independent bucket tables."""
        return [*(["w"] if self.sweeping else []), *(["length"] if self.prefixes else [])]

    @property
    def scopes(self) -> int:
        """How many of them there are."""
        return len(self.widths) * max(1, len(self.prefixes))

    @property
    def codes(self) -> list[str]:
        return [f"k{j}" for j in range(self.key_length)]

    @property
    def keys(self) -> list[str]:
        """Columns that identify a bucket."""
        return [*self.scope, "t", *self.codes]

    def at(self, *widths: float) -> HashFamily:
        """The same planes with other widths."""
        return replace(self, widths=tuple(float(w) for w in widths))

    def times(self, multiplier: int) -> HashFamily:
        """A family with ``multiplier`` times as many tables."""
        if multiplier == 1:
            return self
        return replace(self, num_tables=multiplier * self.num_tables, stored=None)

    def parts(self, tables: int) -> list[HashFamily]:
        """Families that share out the tables, so many to each at most; every one numbers its own from 0."""
        tables = max(1, min(tables, self.num_tables))
        if tables == self.num_tables:
            return [self]
        # As many each as the number of families allows.
        tables = -(-self.num_tables // -(-self.num_tables // tables))
        size = self.key_length
        return [
            replace(self, num_tables=stop - first, stored=(self.planes[first * size : stop * size], self.offsets[first * size : stop * size]))
            for first in range(0, self.num_tables, tables)
            for stop in [min(first + tables, self.num_tables)]
        ]

    def finer(self, halvings: int) -> HashFamily:
        """The same planes at a width halved so many times, with buckets that lie inside each other.

        ``floor(2^j (p / w + u))`` is the code at ``w / 2^j``; half of it, rounded down, is the code one
        halving before. So counts at a fine width add up to those at all coarser ones.
        """
        (width,) = self.widths
        scale = 2.0**halvings
        return replace(self, widths=(width / scale,), stored=(self.planes, self.offsets * scale))

    def shorten(self, key_length: int) -> HashFamily:
        """The same tables with only the first codes of each key; its buckets contain the old ones."""
        shape = (self.num_tables, self.key_length)
        planes = self.planes.reshape(*shape, self.dim)[:, :key_length].reshape(-1, self.dim)
        offsets = self.offsets.reshape(shape)[:, :key_length].reshape(-1)
        return replace(self, key_length=key_length, stored=(planes, offsets))

    @classmethod
    def from_planes_df(cls, table: DataFrame, **params) -> HashFamily:
        """A family with the planes that ``planes_df`` wrote."""
        rows = sorted(table.collect(), key=lambda r: (r.t, r.j))
        return cls(stored=(np.array([r.a for r in rows]), np.array([r.u for r in rows])), **params)

    def planes_df(self, spark) -> DataFrame:
        """``(t, j, a, u)``, one row per plane."""
        rows = [
            (i // self.key_length, i % self.key_length, self.planes[i].tolist(), float(self.offsets[i]))
            for i in range(len(self.offsets))
        ]
        return spark.createDataFrame(rows, "t int, j int, a array<double>, u double")


def cut_keys(rows: DataFrame, family: HashFamily, *carried: str) -> DataFrame:
    """``rows`` of whole keys once for each of the family's prefixes, ``family.keys`` being cut to it."""
    rows = rows.withColumn("length", F.explode(F.array(*[F.lit(n) for n in family.prefixes])))
    codes = [F.when(F.col("length") > j, F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c) for j, c in enumerate(family.codes)]
    return rows.select(*carried, *family.scope, "t", *codes)


def _projection_udf(family: HashFamily):
    planes, offsets = family.planes, family.offsets
    widths, radius = family.widths, family.radius

    # Self-contained, so that workers need nothing but numpy and pyarrow.
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow as pa

        count, dim = planes.shape
        step = max(1, 2_000_000 // count)
        for batch in batches:
            rows, flat = len(batch), batch.flatten()
            if batch.null_count or flat.null_count or len(flat) != rows * dim:
                raise ValueError(f"features must be non-null arrays of {dim} non-null numbers")
            points = flat.to_numpy(zero_copy_only=False).reshape(rows, dim) / radius
            if not np.isfinite(points).all():
                raise ValueError("features must be finite")
            out = np.empty((rows, count))
            for start in range(0, rows, step):
                x = points[start : start + step]
                p = np.matmul(x, planes.T, out=out[start : start + step])
                reach = np.sqrt((x * x).sum(axis=1, keepdims=True)) * 1e-11
                # A matrix product may round differently from batch to batch. Where that could
                # move a code, add the terms in index order instead.
                edge = np.zeros(p.shape, dtype=bool)
                for w in widths:
                    v = p / w + offsets
                    edge |= np.abs(v - np.rint(v)) < reach / w
                i, c = np.nonzero(edge)
                if len(i):
                    total = np.zeros(len(i))
                    for d in range(dim):
                        total += x[i, d] * planes[c, d]
                    p[i, c] = total
            bounds = pa.array(np.arange(rows + 1, dtype=np.int32) * count)
            yield pa.ListArray.from_arrays(bounds, pa.array(out.ravel()))

    return F.arrow_udf(project, "array<double>")


def _projection_native(family: HashFamily, features: Column) -> Column:
    """The same projections as array expressions, without Python workers."""
    planes = F.array(*[doubles(plane) for plane in family.planes])
    scaled = features if family.radius == 1.0 else F.transform(features, lambda x: x / family.radius)
    return F.transform(
        planes,
        lambda a: F.aggregate(F.zip_with(scaled, a, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v),
    )


def hash_points(
    df: DataFrame,
    family: HashFamily,
    features: str = "features",
    keep: Sequence[str] = ("id",),
    per_row_widths: str | None = None,
    native: bool = False,
) -> DataFrame:
    """One row per point and table (and width): ``keep`` columns plus ``family.keys``.

    ``per_row_widths`` names an ``array<struct<w, ...>>`` column with the widths to hash a row
    for, in place of the family's; its other fields are carried along.
    """
    column = F.col(features)
    projected = _projection_native(family, column) if native else _projection_udf(family)(column)
    carried = list(keep)
    rows = df.select(*carried, *([per_row_widths] if per_row_widths else []), projected.alias("_p"))
    if per_row_widths:
        fields = df.schema[per_row_widths].dataType.elementType.fieldNames()
        rows = rows.select(*carried, F.inline(per_row_widths), "_p")
        carried += [f for f in fields if f != "w"]
        width = F.col("w")
    elif family.sweeping:
        rows = rows.select(*carried, F.explode(doubles(family.widths)).alias("w"), "_p")
        width = F.col("w")
    else:
        width = F.lit(float(family.widths[0]))
    tables = F.sequence(F.lit(0), F.lit(family.num_tables - 1))
    rows = rows.select(*rows.columns[:-1], F.explode(tables).alias("t"), "_p")
    offsets = doubles(family.offsets)
    codes = []
    for j, name in enumerate(family.codes):
        plane = F.col("t") * family.key_length + j
        code = F.floor(F.get("_p", plane) / width + F.get(offsets, plane))
        # Never null: saying so spares joins a null filter that would compute every code again.
        codes.append(F.coalesce(code, F.lit(0)).alias(name))
    whole = replace(family, prefixes=())
    hashed = rows.select(*carried, *whole.scope, "t", *codes)
    return cut_keys(hashed, family, *carried) if family.prefixes else hashed
