"""Index arithmetic: linear, Cartesian and Morton indices as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.bits import long, shl, shr
from gridloom.plans.domain import COORDS, Domain, Layout


def delinearize(layout: Layout, domain: Domain, index: Column) -> dict[str, Column]:
    """Coordinate columns (``t z y x``) of a linear index over the domain in the layout's order."""
    out: dict[str, Column] = {}
    rest = index.cast("long")
    for dim, axis in reversed([*zip(layout.dims, layout.axes, strict=True)]):
        n = domain.length(dim)
        out[axis] = rest % n + domain.start(dim)
        rest = F.call_function("div", rest, long(n))
    return {a: out.get(a, long(0)) for a in COORDS}


def linearize(layout: Layout, domain: Domain, coords: Mapping[str, Column] | None = None) -> Column:
    """The linear index of coordinates over the domain in the layout's order; null outside of the domain."""
    coords = coords or {a: F.col(a) for a in COORDS}
    inside = in_domain(layout, domain, coords)
    index = long(0)
    for dim, axis in zip(layout.dims, layout.axes, strict=True):
        index = index * domain.length(dim) + (coords[axis] - domain.start(dim))
    return F.when(inside, index)


def in_domain(layout: Layout, domain: Domain, coords: Mapping[str, Column] | None = None) -> Column:
    """Whether coordinates lie in the domain: a conjunction of ranges, which scans can take over."""
    coords = coords or {a: F.col(a) for a in COORDS}
    terms = [(coords[a] >= domain.start(d)) & (coords[a] < domain.interval(d)[1]) for d, a in zip(layout.dims, layout.axes, strict=True)]
    return reduce(lambda p, q: p & q, terms)


def sub_index(layout: Layout, domain: Domain, sub: Domain) -> Column:
    """For the linear index ``i`` of a sub-domain (column ``i``) the linear index in the domain, or -1 outside of it."""
    return F.coalesce(linearize(layout, domain, delinearize(layout, sub, F.col("i"))), long(-1))


def _groups(size: int, dim: int) -> Column:
    """Ones in groups of ``size`` bits, one group each ``size * dim`` bits."""
    m = 0
    for at in range(0, 63, size * dim):
        m |= ((1 << size) - 1) << at
    return long(m & (1 << 63) - 1)


def _steps(dim: int) -> list[int]:
    return {2: [16, 8, 4, 2, 1], 3: [16, 8, 4, 2, 1], 4: [8, 4, 2, 1]}[dim]


def _spread(x: Column, dim: int) -> Column:
    for s in _steps(dim):
        x = x.bitwiseOR(shl(x, s * (dim - 1))).bitwiseAND(_groups(s, dim))
    return x


def _compact(x: Column, dim: int) -> Column:
    x = x.bitwiseAND(_groups(1, dim))
    for s in reversed(_steps(dim)):
        x = x.bitwiseOR(shr(x, s * (dim - 1))).bitwiseAND(_groups(2 * s, dim) if 2 * s <= 16 else long((1 << 31) - 1))
    return x


def morton_encode(*coords: Column) -> Column:
    """Interleaves 1 to 4 coordinates; the first gives the lowest bit. Up to 31, 21 or 15 bits each in 2, 3 or 4 dimensions."""
    coords = tuple(c.cast("long") for c in coords)
    if len(coords) == 1:
        return coords[0]
    return reduce(lambda p, q: p.bitwiseOR(q), [shl(_spread(c, len(coords)), k) if k else _spread(c, len(coords)) for k, c in enumerate(coords)])


def morton_decode(m: Column, dim: int) -> list[Column]:
    """The coordinates of a Morton index, the one of the lowest bit first."""
    if dim == 1:
        return [m]
    return [_compact(shr(m, k) if k else m, dim) for k in range(dim)]


def morton_of(axes: Sequence[str], starts: Sequence[int] | None = None) -> Column:
    """Morton index of coordinate columns, named slowest first, relative to their starts."""
    starts = starts or [0] * len(axes)
    return morton_encode(*[F.col(a) - s if s else F.col(a) for a, s in reversed([*zip(axes, starts, strict=True)])])


def ancestor(m: Column, dim: int, levels: int | Column) -> Column:
    """The Morton index of the node that many levels above."""
    return shr(m, dim * levels if isinstance(levels, int) else F.lit(dim) * levels)
