"""Deviations from a nominal value and tests against permitted errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.families import approx_equal
from gridloom.plans.types import Elem


def absolute(value: Column, nominal: Column, previous: Column | None = None) -> Column:
    """|v - c| plus what was introduced before."""
    d = F.abs(value.cast("double") - nominal.cast("double"))
    return d if previous is None else d + previous


def relative(value: Column, nominal: Column, previous: Column | None = None) -> Column:
    """|v - c| / |v|; after earlier deviations (p + |v - c|) / min(|v|, |v - p|, |v + p|).

    0 where nothing deviates, infinite where something deviates from 0.
    """
    v, d = value.cast("double"), absolute(value, nominal)
    if previous is None:
        over, under = d, F.abs(v)
    else:
        fresh = previous == 0
        over = F.when(fresh, d).otherwise(d + previous)
        under = F.when(fresh, F.abs(v)).otherwise(F.least(F.abs(v), F.abs(v - previous), F.abs(v + previous)))
    return F.when(over == 0, F.lit(0.0)).when(under == 0, F.lit(float("inf"))).otherwise(over / F.nullif(under, F.lit(0.0)))


def skipping(deviation: Column, value: Column, missing: float | int, kind: Elem) -> Column:
    """0 for missing values."""
    return F.when(approx_equal(value, F.lit(missing).cast(kind.spark), kind), F.lit(0.0)).otherwise(deviation)


def complies(abs_dev: Column, rel_dev: Column, abs_eps: Column, rel_eps: Column) -> Column:
    """Whether all permitted errors hold; a null bound permits anything."""
    return (abs_eps.isNull() | (abs_dev <= abs_eps)) & (rel_eps.isNull() | (rel_dev <= rel_eps))
