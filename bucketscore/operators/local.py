"""Buckets of whole batches of points with NumPy, inside tasks: counts merged before they leave Python,
and sums over the buckets of a bounded table without a row per point and hash table.

Codes are those of ``hash_points``, bit for bit. Spark reads, spreads and merges; these functions only
see batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.operators.lsh import HashFamily

# Numbers of the features of the points that a task hashes at a time.
CELLS = 1 << 20
# Packed keys stay below this.
PACKED = 2.0**52


def _hasher(family: HashFamily):
    """Functions for checked and scaled points of a batch, their projections in a table, and their codes there."""
    planes, offsets, size, radius = family.planes, family.offsets, family.key_length, family.radius

    # Self-contained, so that workers need nothing but numpy and pyarrow.
    def points(batch):
        import numpy as np

        dim, rows, flat = planes.shape[1], len(batch), batch.flatten()
        if batch.null_count or flat.null_count or len(flat) != rows * dim:
            raise ValueError(f"features must be non-null arrays of {dim} non-null numbers")
        x = flat.to_numpy(zero_copy_only=False).reshape(rows, dim) / radius
        if not np.isfinite(x).all():
            raise ValueError("features must be finite")
        return x, np.sqrt((x * x).sum(axis=1)) * 1e-11

    def project(x, t):
        import numpy as np

        return np.matmul(planes[t * size : (t + 1) * size], np.ascontiguousarray(x.T))

    def codes(x, reach, p, t, w):
        """One row per code."""
        import numpy as np

        v = p / w
        v += offsets[t * size : (t + 1) * size, None]
        found = np.floor(v)
        v -= found
        near = reach / w
        # What a differently rounded product could move is summed in index order.
        c, i = np.nonzero((v <= near) | (v >= 1 - near))
        if len(i):
            total = np.zeros(len(i))
            for d in range(x.shape[1]):
                total += x[i, d] * planes[t * size + c, d]
            found[c, i] = np.floor(total / w + offsets[t * size + c])
        return found

    return points, project, codes


def local_counts(points: DataFrame, family: HashFamily, features: str) -> DataFrame:
    """``family.keys`` and ``n`` per batch of points; the same bucket comes once from each batch at most."""
    points_of, project, codes = _hasher(family)
    widths, tables, size, names = family.widths, family.num_tables, family.key_length, family.keys + ["n"]
    sweeping, step, most = family.sweeping, max(1, CELLS // family.dim), PACKED

    def tally(found):
        """Distinct columns of ``found`` and how often they occur."""
        import numpy as np

        low = found.min(axis=1)
        span = found.max(axis=1) - low + 1
        if float(np.prod(span)) > most:
            distinct, n = np.unique(found, axis=1, return_counts=True)
            return distinct.astype(np.int64), n
        packed = found[0] - low[0]
        for j in range(1, size):
            packed = packed * span[j] + (found[j] - low[j])
        packed = packed.astype(np.int64)
        if np.prod(span) <= 4 * len(packed):
            n = np.bincount(packed)
            packed = np.flatnonzero(n)
            n = n[packed]
        else:
            packed.sort()
            first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
            n = np.diff(np.append(first, len(packed)))
            packed = packed[first]
        distinct = np.empty((size, len(packed)), np.int64)
        for j in range(size - 1, 0, -1):
            packed, distinct[j] = np.divmod(packed, int(span[j]))
            distinct[j] += int(low[j])
        distinct[0] = packed + int(low[0])
        return distinct, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def merged(held):
            x, reach = (np.concatenate(c) for c in zip(*held))
            parts, rows = [], 0
            for w in widths:
                for t in range(tables):
                    distinct, n = tally(codes(x, reach, project(x, t), t, w))
                    own = [np.full(len(n), t, np.int32), *distinct, n.astype(np.int64)]
                    parts.append([np.full(len(n), w), *own] if sweeping else own)
                    rows += len(n)
                    if rows >= 1 << 16 or (w, t) == (widths[-1], tables - 1):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)
                        parts, rows = [], 0

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(points_of(batch.column(0)))
                rows += batch.num_rows
            if rows >= step:
                yield from merged(held)
                held, rows = [], 0
        if held:
            yield from merged(held)

    schema = ", ".join([*(["w double"] if sweeping else []), "t int", *[f"{c} bigint" for c in family.codes], "n bigint"])
    return points.select(features).mapInArrow(run, schema)


class Lookup:
    """Buckets ``family.keys`` of a bounded table as sorted packed keys, for each scope and hash table."""

    def __init__(self, family: HashFamily, keys: pa.Table) -> None:
        t = keys["t"].to_numpy()
        codes = np.array([keys[c].to_numpy() for c in family.codes], dtype=np.float64).reshape(family.key_length, len(t))
        lengths = family.prefixes or (family.key_length,)
        self.scopes = [(w, length) for w in family.widths for length in lengths]
        self.parts, self.packs = {}, True
        for s, (w, length) in enumerate(self.scopes):
            mine = np.ones(len(t), bool)
            if family.sweeping:
                mine &= keys["w"].to_numpy() == w
            if family.prefixes:
                mine &= keys["length"].to_numpy() == length
            for table in range(family.num_tables):
                rows = np.flatnonzero(mine & (t == table))
                if not len(rows):
                    continue
                own = codes[:length, rows]
                low = own.min(axis=1)
                span = own.max(axis=1) - low + 1
                self.packs = self.packs and float(np.prod(span)) <= PACKED
                packed = self._packed(own, low, span)
                order = np.argsort(packed, kind="stable")
                self.parts[s, table] = (low, span, packed[order], rows[order])

    @staticmethod
    def _packed(codes, low, span):
        packed = codes[0] - low[0]
        for j in range(1, len(low)):
            packed = packed * span[j] + (codes[j] - low[j])
        return packed.astype(np.int64)


def _finder(family: HashFamily, table: Lookup):
    """``find(batch)`` yields, for each scope and hash table, which points meet a bucket and its row in the table."""
    points_of, project, codes = _hasher(family)
    parts, tables, widths = table.parts, family.num_tables, family.widths
    lengths = family.prefixes or (family.key_length,)

    def find(batch):
        import numpy as np

        x, reach = points_of(batch)
        for t in range(tables):
            p = project(x, t)
            for i, w in enumerate(widths):
                if not any((i * len(lengths) + j, t) in parts for j in range(len(lengths))):
                    continue
                found = codes(x, reach, p, t, w)
                for j, length in enumerate(lengths):
                    scope = i * len(lengths) + j
                    if (scope, t) not in parts:
                        continue
                    low, span, known, rows = parts[scope, t]
                    inside = np.ones(len(x), bool)
                    packed = np.zeros(len(x))
                    for k in range(length):
                        at = found[k] - low[k]
                        inside &= (at >= 0) & (at < span[k])
                        packed = packed * span[k] + at
                    met = np.flatnonzero(inside)
                    packed = packed[met].astype(np.int64)
                    if np.prod(span) <= 16 * len(known) + 4096:
                        place = np.full(int(np.prod(span)), -1)
                        place[known] = np.arange(len(known))
                        at = place[packed]
                        same = at >= 0
                    else:
                        at = np.minimum(np.searchsorted(known, packed), len(known) - 1)
                        same = known[at] == packed
                    yield scope, met[same], rows[at[same]]

    return find


def local_sums(family: HashFamily, table: Lookup, whole: np.ndarray, real: np.ndarray, merge: bool, features: Column) -> Column:
    """A struct of two arrays per point: sums of the columns of ``whole`` and ``real`` over its buckets, scope by scope."""
    find, scopes = _finder(family, table), 1 if merge else len(table.scopes)

    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [np.zeros((len(batch), scopes, values.shape[1]), values.dtype) for values in (whole, real)]
            for scope, points, rows in find(batch):
                for total, values in zip(out, (whole, real)):
                    total[points, 0 if merge else scope] += values[rows]
            lists = []
            for total in out:
                width = total.shape[1] * total.shape[2]
                bounds = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width)
                lists.append(pa.ListArray.from_arrays(bounds, pa.array(total.ravel())))
            yield pa.StructArray.from_arrays(lists, ["whole", "real"])

    return F.arrow_udf(sums, "whole array<bigint>, real array<double>")(features)


def local_members(points: DataFrame, family: HashFamily, table: Lookup, features: str) -> DataFrame:
    """``(row, n)``: how many points each row of the table has, ``n`` of them in a partition."""
    find = _finder(family, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, rows in find(batch.column(0)):
                more = np.bincount(rows, minlength=len(total))
                more[: len(total)] += total
                total = more
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["row", "n"])

    return points.select(features).mapInArrow(run, "row bigint, n bigint")
