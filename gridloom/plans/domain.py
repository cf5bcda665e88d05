"""Dimensions, layouts and domains: what describes a grid without its values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

#: Dimension names in order of their numbers, and the coordinate columns that hold them.
DIMENSIONS = ("Lon", "Lat", "Lev", "Time")
AXES = {"Lon": "x", "Lat": "y", "Lev": "z", "Time": "t"}
#: Coordinate columns of every grid, slowest first; unused ones hold 0.
COORDS = ("t", "z", "y", "x")

#: Layouts by their number in the container format; the gaps are unused numbers.
LAYOUTS = {
    1: "Lon_", 2: "Lat_", 3: "Lev_", 4: "Time_",
    6: "Lat_Lon", 7: "Lon_Lat", 8: "Lat_Lev", 9: "Lev_Lat", 10: "Lon_Lev", 11: "Lev_Lon",
    13: "Lat_Lon_Lev", 14: "Lat_Lev_Lon", 15: "Lev_Lat_Lon", 16: "Lev_Lon_Lat", 17: "Lon_Lev_Lat", 18: "Lon_Lat_Lev",
    20: "Time_Lev_Lat_Lon", 21: "Time_Lev_Lon_Lat", 22: "Time_Lat_Lev_Lon", 23: "Time_Lat_Lon_Lev", 24: "Time_Lon_Lev_Lat", 25: "Time_Lon_Lat_Lev",
    26: "Lev_Time_Lat_Lon", 27: "Lev_Time_Lon_Lat", 28: "Lev_Lat_Time_Lon", 29: "Lev_Lat_Lon_Time", 30: "Lev_Lon_Time_Lat", 31: "Lev_Lon_Lat_Time",
    32: "Lat_Time_Lev_Lon", 33: "Lat_Time_Lon_Lev", 34: "Lat_Lev_Time_Lon", 35: "Lat_Lev_Lon_Time", 36: "Lat_Lon_Time_Lev", 37: "Lat_Lon_Lev_Time",
    38: "Lon_Time_Lev_Lat", 39: "Lon_Time_Lat_Lev", 40: "Lon_Lev_Time_Lat", 41: "Lon_Lev_Lat_Time", 42: "Lon_Lat_Time_Lev", 43: "Lon_Lat_Lev_Time",
}
_CODES = {name: code for code, name in LAYOUTS.items()}


@dataclass(frozen=True)
class Layout:
    """An order of dimensions; the first varies slowest."""

    dims: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.dims or len(set(self.dims)) != len(self.dims) or not set(self.dims) <= set(DIMENSIONS):
            raise ValueError(f"no layout: {self.dims}")

    @classmethod
    def parse(cls, name: str | Layout | Iterable[str]) -> Layout:
        if isinstance(name, Layout):
            return name
        parts = name.split("_") if isinstance(name, str) else name
        return cls(tuple(x for x in parts if x))

    @classmethod
    def default(cls, dim: int) -> Layout:
        """Lon, Lat_Lon, Lev_Lat_Lon or Time_Lev_Lat_Lon."""
        return cls(tuple(reversed(DIMENSIONS[:dim])))

    @classmethod
    def by_code(cls, code: int) -> Layout:
        return cls.parse(LAYOUTS[code])

    @property
    def name(self) -> str:
        return self.dims[0] + "_" if len(self.dims) == 1 else "_".join(self.dims)

    @property
    def code(self) -> int:
        return _CODES[self.name]

    @property
    def axes(self) -> tuple[str, ...]:
        """The coordinate columns, slowest first."""
        return tuple(AXES[d] for d in self.dims)

    @property
    def dimensionality(self) -> int:
        return len(self.dims)

    @property
    def curve(self) -> Layout:
        """The same dimensions as the Morton curve takes them, whatever their order: Lon last, as it has the lowest bit."""
        return Layout(tuple(d for d in reversed(DIMENSIONS) if d in self.dims))

    def without(self, dim: str) -> Layout:
        return Layout(tuple(d for d in self.dims if d != dim))


@dataclass(frozen=True)
class Domain:
    """Half-open intervals per dimension; a dimension that is absent is [0, 1)."""

    intervals: Mapping[str, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, **intervals: tuple[int, int] | int) -> Domain:
        """``Domain.of(lon=(3, 7), lat=2)``; a number is a length from 0."""
        return cls({k.capitalize(): (0, v) if isinstance(v, int) else tuple(v) for k, v in intervals.items()})

    @classmethod
    def default(cls, layout: Layout, lengths: Iterable[int]) -> Domain:
        """From 0, with lengths in the layout's order."""
        lengths = tuple(lengths)
        if len(lengths) != len(layout.dims):
            raise ValueError(f"{len(lengths)} lengths for layout {layout.name}")
        return cls({d: (0, int(n)) for d, n in zip(layout.dims, lengths, strict=True)})

    @classmethod
    def from_hyperslab(cls, slab: Hyperslab) -> Domain:
        return cls({d: (s, s + c) for d, (s, c) in slab.parts.items() if (s, c) != (0, 1)})

    def interval(self, dim: str) -> tuple[int, int]:
        return tuple(self.intervals.get(dim, (0, 1)))

    def start(self, dim: str) -> int:
        return self.interval(dim)[0]

    def length(self, dim: str) -> int:
        s, e = self.interval(dim)
        return e - s

    def lengths(self, layout: Layout) -> tuple[int, ...]:
        return tuple(self.length(d) for d in layout.dims)

    def starts(self, layout: Layout) -> tuple[int, ...]:
        return tuple(self.start(d) for d in layout.dims)

    @property
    def dimensionality(self) -> int:
        """Dimensions of length over 1."""
        return sum(self.length(d) > 1 for d in DIMENSIONS)

    @property
    def size(self) -> int:
        """Cells: the product of all lengths of at least 1."""
        n = 1
        for d in DIMENSIONS:
            n *= max(self.length(d), 1)
        return n

    @property
    def is_valid(self) -> bool:
        return all(0 <= s < e for s, e in (self.interval(d) for d in DIMENSIONS))

    def largest_length(self) -> int:
        return max(self.length(d) for d in DIMENSIONS)

    def with_interval(self, dim: str, start: int, end: int) -> Domain:
        """Sets or extends a dimension."""
        return Domain({**self.intervals, dim: (start, end)})

    def without(self, dim: str) -> Domain:
        return Domain({d: v for d, v in self.intervals.items() if d != dim})

    def minus(self, other: Domain) -> Domain:
        """Intervals relative to the starts of ``other``."""
        return Domain({d: (self.start(d) - other.start(d), self.interval(d)[1] - other.start(d)) for d in self.intervals})

    def from_zero(self) -> Domain:
        return self.minus(self)

    def contains(self, other: Domain) -> bool:
        return all(self.start(d) <= other.start(d) and other.interval(d)[1] <= self.interval(d)[1] for d in DIMENSIONS)

    def same_as(self, other: Domain) -> bool:
        """Whether starts and ends are equal in all dimensions."""
        return all(self.interval(d) == other.interval(d) for d in DIMENSIONS)

    def hyperslab(self) -> Hyperslab:
        return Hyperslab({d: (s, e - s) for d, (s, e) in self.intervals.items()})


@dataclass(frozen=True)
class Hyperslab:
    """(start, count) per dimension; (0, 1) where absent."""

    parts: Mapping[str, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, **parts: tuple[int, int]) -> Hyperslab:
        return cls({k.capitalize(): tuple(v) for k, v in parts.items()})

    def part(self, dim: str) -> tuple[int, int]:
        return tuple(self.parts.get(dim, (0, 1)))

    @property
    def size(self) -> int:
        n = 1
        for d in DIMENSIONS:
            n *= self.part(d)[1]
        return n


def pyramid_depth(largest: int) -> int:
    """Coarsening steps of a grid: ceil(log2(n) + eps), as the container's headers count them (1 and 2 take one more than needed)."""
    import math
    import sys

    return math.ceil(math.log2(max(largest, 1)) + sys.float_info.epsilon)


def pyramid_dims(lengths: tuple[int, ...], depth: int | None = None) -> list[tuple[int, ...]]:
    """Lengths of all levels, finest first; each is the half of the one before, rounded up."""
    out = [tuple(lengths)]
    for _ in range(pyramid_depth(max(lengths)) if depth is None else depth):
        out.append(tuple(-(-n // 2) for n in out[-1]))
    return out


@dataclass(frozen=True)
class GridMeta:
    """What a variable is apart from its cells."""

    name: str
    elem: object
    layout: Layout
    domain: Domain
    missing: float | int | None = None
    scale: float = 1.0
    offset: float = 0.0
    #: The scale and the offset's own element types: equal to ``elem`` or not decides the type after scaling.
    scale_elem: str = "double"
    offset_elem: str = "double"
    context: int | None = None

    def __post_init__(self) -> None:
        if self.missing is None:
            object.__setattr__(self, "missing", self.elem.lowest)

    def but(self, **changes) -> GridMeta:
        return replace(self, **changes)

    @property
    def lengths(self) -> tuple[int, ...]:
        return self.domain.lengths(self.layout)

    @property
    def dimensionality(self) -> int:
        return self.layout.dimensionality

    @property
    def depth(self) -> int:
        return pyramid_depth(max(self.lengths))
