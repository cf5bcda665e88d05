"""Interpolations and predictors of a family: the cells that share a parent.

A family is either a group (aggregate expressions) or an ordered array of its members; members stand in Morton order,
which is row-major order within a family.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.bits import abs_difference, leading_zeros, long, to_bits, unsigned_ge, wrap_sub
from gridloom.plans.types import Elem

#: Turns the members' values (null where there is none) into an aggregate.
Interpolation = Callable[[Column], Column]


def approx_equal(a: Column, b: Column, kind: Elem) -> Column:
    """Floats within four epsilons (absolute), integers equal."""
    return F.abs(a - b) < 4 * kind.epsilon if kind.is_float else a == b


def unless_missing(x: Column, missing: float | int, kind: Elem) -> Column:
    """The value, or null where it is the missing value."""
    return F.when(~approx_equal(x, F.lit(missing).cast(kind.spark), kind), x)


def _half(kind: Elem) -> Callable[[Column], Column]:
    """v / 2, towards zero for integers."""
    if kind.is_float:
        return lambda v: v / 2
    if kind.name == "uint64":
        return lambda v: F.floor(v / 2)
    return lambda v: F.call_function("div", v, F.lit(2))


def mean(kind: Elem) -> Interpolation:
    """Arithmetic mean: summed up in double precision, then cast (towards zero for integers)."""
    return lambda x: F.avg(x.cast("double")).cast(kind.spark)


def mid_range(kind: Elem) -> Interpolation:
    """max/2 + min/2 in the element type; a single value stays as it is."""
    half = _half(kind)
    return lambda x: F.when(F.count(x) == 1, F.min(x)).otherwise((half(F.max(x)) + half(F.min(x))).cast(kind.spark)).cast(kind.spark)


def mean_skipping(kind: Elem, missing: float | int) -> Interpolation:
    """The mean of the members that aren't missing; the missing value if all are."""
    return lambda x: F.coalesce(F.avg(unless_missing(x, missing, kind).cast("double")).cast(kind.spark), F.lit(missing).cast(kind.spark))


def mid_range_skipping(kind: Elem, missing: float | int) -> Interpolation:
    """(max + min) / 2 of the members that aren't missing; the missing value if all are."""

    def of(x: Column) -> Column:
        good = unless_missing(x, missing, kind).cast("double" if kind.is_float else "bigint")
        both = F.max(good) + F.min(good)
        middle = both / 2 if kind.is_float else F.call_function("div", both, F.lit(2))
        return F.coalesce(middle.cast(kind.spark), F.lit(missing).cast(kind.spark))

    return of


def upper_median(kind: Elem) -> Interpolation:
    """The member at place n/2 of the sorted family."""

    def of(x: Column) -> Column:
        family = F.sort_array(F.collect_list(x))
        return F.get(family, F.floor(F.size(family) / 2).cast("int")).cast(kind.spark)

    return of


# --- predictors over the family as an array -----------------------------------------------------------------------


def array_mean(values: Column, kind: Elem) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return (total / F.size(values)).cast(kind.spark)


def array_mid_range(values: Column, kind: Elem) -> Column:
    half = _half(kind)
    middle = (half(F.array_max(values)) + half(F.array_min(values))).cast(kind.spark)
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(middle)


def zeros_score(candidate: Column, family: Column, width: int) -> Column:
    """Leading zeros of all residuals against a candidate, added up."""
    return F.aggregate(family, F.lit(0), lambda a, v: a + leading_zeros(abs_difference(candidate, v, width), width))


def best_by_zeros(family: Column, candidates: Column, width: int) -> Column:
    """The place (from 1) of the candidate whose residuals have most leading zeros; the first of equals."""
    scores = F.transform(candidates, lambda c: zeros_score(c, family, width))
    return F.array_position(scores, F.array_max(scores)).cast("int")


def xor_zeros(candidate: Column, family: Column, width: int) -> Column:
    """Leading zeros that all XOR residuals against a candidate share."""
    return leading_zeros(F.aggregate(family, long(0), lambda a, v: a.bitwiseOR(candidate.bitwiseXOR(v))), width)


def best_by_xor(family: Column, mid_bits: Column, mean_bits: Column, width: int) -> Column:
    """The place of the candidate with most shared zeros: members first, then the mean (n + 2), then the mid-range (n + 1)."""
    members = F.transform(family, lambda c: xor_zeros(c, family, width))
    most = F.array_max(members)
    by_mean, by_mid = xor_zeros(mean_bits, family, width), xor_zeros(mid_bits, family, width)
    n = F.size(family)
    return F.when((most >= by_mean) & (most >= by_mid), F.array_position(members, most).cast("int")).when(by_mean >= by_mid, n + 2).otherwise(n + 1)


def residual(approx: Column, real: Column, width: int) -> tuple[Column, Column]:
    """(whether the approximation is not below the real pattern, their difference)."""
    greater = unsigned_ge(approx, real, width)
    return greater, F.when(greater, wrap_sub(approx, real, width)).otherwise(wrap_sub(real, approx, width))


def float_bits(x: Column, kind: Elem) -> Column:
    """Patterns of computed predictors; NaN gives its canonical pattern."""
    return to_bits(x, kind)
