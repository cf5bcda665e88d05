"""Permitted errors: general ones and ones that hold in a box."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.domain import AXES, DIMENSIONS, Domain


@dataclass(frozen=True)
class Rule:
    criterion: str
    error: float
    box: Domain | None = None

    def __post_init__(self) -> None:
        if self.criterion not in ("abs", "rel") or not self.error >= 0:
            raise ValueError(f"no permitted error: {self.criterion} {self.error}")

    def touches(self, level: Column | int = 0) -> Column:
        """Whether an element of that level (0: a cell) holds a cell of the box; coordinates are the element's own."""
        if self.box is None:
            return F.lit(True)
        span = F.pow(F.lit(2.0), level).cast("long") if isinstance(level, Column) else F.lit(1 << level)
        terms = []
        for d in DIMENSIONS:
            if d in self.box.intervals:
                s, e = self.box.interval(d)
                low = F.col(AXES[d]) * span
                terms.append((low < e) & (low + span > s))
        return reduce(lambda a, b: a & b, terms, F.lit(True))


@dataclass(frozen=True)
class ErrorRules:
    """A set of rules: of all that touch an element the least absolute and the least relative error hold."""

    rules: tuple[Rule, ...] = ()

    def general(self, criterion: str, error: float) -> ErrorRules:
        return ErrorRules((*self.rules, Rule(criterion, error)))

    def region(self, criterion: str, error: float, box: Domain) -> ErrorRules:
        return ErrorRules((*self.rules, Rule(criterion, error, box)))

    def bound(self, criterion: str, level: Column | int = 0) -> Column:
        """The least error of that criterion, or null: a few comparisons per row in place of a join."""
        found = [F.when(r.touches(level), F.lit(float(r.error))) for r in self.rules if r.criterion == criterion]
        none = F.lit(None).cast("double")
        return none if not found else found[0] if len(found) == 1 else F.least(*found)

    def restricting(self, df: DataFrame, level: Column | int = 0) -> DataFrame:
        """Adds ``abs_eps`` and ``rel_eps``."""
        return df.withColumns({"abs_eps": self.bound("abs", level), "rel_eps": self.bound("rel", level)})
