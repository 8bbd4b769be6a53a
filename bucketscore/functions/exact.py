"""Sums of doubles that come out the same in any order of addition.

A double is cut into a whole number and four fractions of 24 bits. Those are added as integers, by
the usual partial aggregation, and put together once at the end. So equal sums are equal doubles, and
sums that differ keep their order, however the rows were spread. The terms of a sum have one sign.
What lies below 2^-96 is left out; a group may have 2^39 terms and a sum of 2^63.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 24
FRACTIONS = 4


def parts_sums(value: Column, name: str) -> list[Column]:
    """Aggregates ``name_0, name_1, ...`` of the parts of ``value``; ``exact_total`` needs them all."""
    return [F.sum(part).alias(f"{name}_{k}") for k, part in enumerate(parts(value))]


def parts(value: Column) -> list[Column]:
    """The whole number and the fractions that ``value`` is cut into."""
    unit = 2.0**BITS
    value = value.cast("double")
    return [part.cast("bigint") for part in [value, *[(value * unit**k) % unit for k in range(1, FRACTIONS + 1)]]]


def exact_total(name: str) -> Column:
    """The sum whose parts ``parts_sums`` added, as a double; null if there was no term."""
    sums = [F.col(f"{name}_{k}") for k in range(FRACTIONS + 1)]
    fraction, carry = F.lit(0.0), F.lit(0).cast("bigint")
    for part in reversed(sums[1:]):
        part = F.abs(part) + carry
        carry = F.shiftright(part, BITS)
        fraction = (fraction + part.bitwiseAND((1 << BITS) - 1)) / 2.0**BITS
    negative = sums[0] < 0
    for part in sums[1:]:
        negative = negative | (part < 0)
    size = (F.abs(sums[0]) + carry) + fraction
    return F.when(negative, -size).otherwise(size)


def inverse_sums(count: Column, name: str) -> list[Column]:
    """Aggregates ``name_0, name_1`` of ``1 / count`` for whole numbers, by integer division.

    The members of a bucket of C rows have a reach of C at least, so their inverses add up to 1 at most
    and the sums fit. Terms are exact to 2^-82, for counts below 2^42.
    """
    count = count.cast("bigint")
    unit = F.lit(1 << 62)
    rest = F.call_function("div", F.shiftleft(unit % count, 20), count)
    return [F.sum(F.call_function("div", unit, count)).alias(f"{name}_0"), F.sum(rest).alias(f"{name}_1")]


def inverse_total(name: str) -> Column:
    """The sum of inverses whose parts ``inverse_sums`` added, as a double."""
    return F.col(f"{name}_0") / F.lit(2.0**62) + F.col(f"{name}_1") / F.lit(2.0**82)
