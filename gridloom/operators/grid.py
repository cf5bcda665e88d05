"""Grids as long tables: cells in, sub-domains, scaling and splitting.

A grid's table has ``var, t, z, y, x, value``; coordinates of dimensions that it lacks are 0. Its ``GridMeta`` has
the element type, layout, domain and missing value, which stands in cells as a plain value and never as null.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.bits import long
from gridloom.functions.coords import delinearize, in_domain, linearize, morton_of
from gridloom.functions.families import approx_equal
from gridloom.plans.domain import AXES, COORDS, Domain, GridMeta, Hyperslab, Layout
from gridloom.plans.types import Elem, elem


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    meta: GridMeta

    @property
    def axes(self) -> tuple[str, ...]:
        """Its coordinate columns, slowest first."""
        return self.meta.layout.axes

    @property
    def along_curve(self) -> Grid:
        """The same cells in the Morton curve's own layout."""
        return Grid(self.df, self.meta.but(layout=self.meta.layout.curve))


COLUMNS = ("var", *COORDS, "value")


def grid_of(df: DataFrame, name: str, kind: str | Elem, layout: str | Layout, domain: Domain, value: Column | str = "value", coords: dict[str, Column] | None = None, **meta) -> Grid:
    """A grid from a table with coordinate expressions by column (``t z y x``) and a value expression."""
    kind, layout = elem(kind), Layout.parse(layout)
    coords = coords or {a: F.col(a) for a in layout.axes}
    value = F.col(value) if isinstance(value, str) else value
    cells = df.select(F.lit(name).alias("var"), *[coords.get(a, F.lit(0)).cast("long").alias(a) for a in COORDS], value.cast(kind.spark).alias("value"))
    return Grid(cells, GridMeta(name, kind, layout, domain, **meta))


def from_values(spark: SparkSession, values: Iterable, name: str, kind: str | Elem, layout: str | Layout, domain: Domain, **meta) -> Grid:
    """A small grid from values in linear order, as many as the domain has cells."""
    kind, layout = elem(kind), Layout.parse(layout)
    rows = [(i, v) for i, v in enumerate(values)]
    if len(rows) != domain.size:
        raise ValueError(f"{len(rows)} values for a domain of {domain.size} cells")
    df = spark.createDataFrame(rows, f"i long, value {kind.spark}")
    return grid_of(df, name, kind, layout, domain, coords=delinearize(layout, domain, F.col("i")), **meta)


def append(grid: Grid, more: DataFrame, index: str | None = None, slab: Hyperslab | None = None) -> Grid:
    """Adds cells, given by coordinate columns, by a linear index of the domain, or by their place in a hyperslab."""
    meta = grid.meta
    if slab is not None:
        part = Domain.from_hyperslab(slab)
        coords = delinearize(meta.layout, Domain({d: part.interval(d) for d in meta.layout.dims}), F.col(index or "i"))
    elif index is not None:
        coords = delinearize(meta.layout, meta.domain, F.col(index))
    else:
        coords = {a: F.col(a) if a in more.columns else long(0) for a in COORDS}
    cells = more.select(F.lit(meta.name).alias("var"), *[coords[a].cast("long").alias(a) for a in COORDS], F.col("value").cast(meta.elem.spark).alias("value"))
    return Grid(grid.df.unionByName(cells), meta)


def spine(spark: SparkSession, layout: Layout, domain: Domain) -> DataFrame:
    """All coordinates of a domain, generated in parallel."""
    coords = delinearize(layout, domain, F.col("id"))
    return spark.range(domain.size).select(*[coords[a].alias(a) for a in COORDS])


def slice_grid(grid: Grid, sub: Domain, pad: bool = True) -> Grid:
    """The cells of a sub-domain. ``pad``: cells that the grid lacks, or that lie outside of its domain, hold the missing value."""
    meta = grid.meta
    sub = Domain({d: sub.interval(d) if d in sub.intervals else meta.domain.interval(d) for d in meta.layout.dims})
    inside = grid.df.filter(in_domain(meta.layout, sub))
    if pad:
        missing = F.lit(meta.missing).cast(meta.elem.spark)
        cells = spine(grid.df.sparkSession, meta.layout, sub).join(inside.drop("var"), [*COORDS], "left")
        inside = cells.select(F.lit(meta.name).alias("var"), *COORDS, F.coalesce("value", missing).alias("value"))
    return Grid(inside, meta.but(domain=sub))


def linear(grid: Grid) -> DataFrame:
    """``var, i, value``: cells by their linear index."""
    return grid.df.select("var", linearize(grid.meta.layout, grid.meta.domain).alias("i"), "value")


def with_morton(grid: Grid) -> DataFrame:
    """Adds ``m``, the Morton index relative to the domain's start."""
    layout = grid.meta.layout.curve
    return grid.df.withColumn("m", morton_of(layout.axes, grid.meta.domain.starts(layout)))


def apply_scaling(grid: Grid) -> Grid:
    """``scale * v + offset`` where v is not missing.

    A scale of 1 or an offset of 0 is left out; without either the grid stays as it is. The result has the element
    type if the attributes have it too, and float otherwise; the missing value is kept.
    """
    meta = grid.meta
    scale = None if abs(meta.scale - 1.0) < 4 * 2.220446049250313e-16 else meta.scale
    offset = None if abs(meta.offset) < 4 * 2.220446049250313e-16 else meta.offset
    if scale is None and offset is None:
        return grid
    used = [e for x, e in ((scale, meta.scale_elem), (offset, meta.offset_elem)) if x is not None]
    kind = meta.elem if all(elem(e) == meta.elem for e in used) else elem("float")
    wide = "double" if kind.is_float else kind.spark
    v = F.col("value").cast(wide)
    if scale is not None:
        v = v * F.lit(scale).cast(wide)
    if offset is not None:
        v = v + F.lit(offset).cast(wide)
    is_missing = approx_equal(F.col("value"), F.lit(meta.missing).cast(meta.elem.spark), meta.elem)
    value = F.when(is_missing, F.lit(meta.missing).cast(kind.spark)).otherwise(v.cast(kind.spark))
    return Grid(grid.df.withColumn("value", value), meta.but(elem=kind, scale=1.0, offset=0.0))


def split_by_dimension(grid: Grid, dim: str) -> dict[int, Grid]:
    """One grid per index of a dimension, which leaves their layout; the index is their context."""
    meta, axis = grid.meta, AXES[dim]
    layout, domain = meta.layout.without(dim), meta.domain.without(dim)
    start, end = meta.domain.interval(dim)
    return {k: Grid(grid.df.filter(F.col(axis) == k).withColumn(axis, long(0)), meta.but(layout=layout, domain=domain, context=k)) for k in range(start, end)}


def split_table(grid: Grid, dim: str) -> DataFrame:
    """All those grids in one table: ``var, context, t, z, y, x, m, value``, with Morton indices of what is left."""
    layout = grid.meta.layout.without(dim).curve
    cells = grid.df.withColumn("context", F.col(AXES[dim])).withColumn(AXES[dim], long(0))
    return cells.select("var", "context", *COORDS, morton_of(layout.axes, grid.meta.domain.starts(layout)).alias("m"), "value")


def hollow(grid: Grid, name: str | None = None) -> Grid:
    """The same description without cells."""
    return Grid(grid.df.limit(0), grid.meta.but(name=name or grid.meta.name))


def filled(grid: Grid, value: float | int) -> Grid:
    """The same cells, all of one value."""
    return Grid(grid.df.withColumn("value", F.lit(value).cast(grid.meta.elem.spark)), grid.meta)


def cast_grid(grid: Grid, kind: str | Elem) -> Grid:
    kind = elem(kind)
    return Grid(grid.df.withColumn("value", F.col("value").cast(kind.spark)), grid.meta.but(elem=kind))
