"""Hierarchical compression of grids and its inverse.

A cell's key is its Morton index, so all its ancestors are its prefixes. Cells are dealt out once by an ancestor a few
levels up (a tile) and sorted once; then each coarsening step is a window over the cells of one parent, and since each
step's parents are prefixes of the same sort keys, a tile climbs several levels without another shuffle or sort. The
tiles' corner cells go on as the next, much smaller table. Restoring runs the same way down.

What stands at level 0 are the cells; at each level a cell has a residual against its parent's value. Mesh elements that
cover many cells stand at the level of their size and pass the levels below as families of one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.bits import family_prefix, from_bits, keep_front, leading_zeros, long, payload, shl, shr, to_bits, wrap_add, wrap_sub
from gridloom.functions.coords import ancestor, morton_decode, morton_of
from gridloom.functions.families import array_mean, array_mid_range, best_by_xor, best_by_zeros, residual
from gridloom.functions.symbols import SIGN, signed_zeros
from gridloom.operators.grid import Grid
from gridloom.plans.domain import COORDS, Domain, GridMeta, pyramid_dims
from gridloom.plans.storage import shared_folder, written
from gridloom.plans.types import Elem

#: Levels that a tile of cells climbs at a time, by dimensionality (64 to 256 cells); further up, where few are left, twice as many.
TILE_LEVELS = {1: 6, 2: 3, 3: 2, 4: 2}
RESIDUAL = "var string, level int, m bigint, nbits int, payload bigint, symbol bigint"
_RES = "struct<level:int,nbits:int,payload:bigint,symbol:bigint>"


@dataclass(frozen=True)
class Pyramid:
    """Residuals of all levels (``var, level, m, nbits, payload, symbol``) and what stands at the top (``var, m, bits, len``)."""

    scheme: str
    meta: GridMeta
    depth: int
    residuals: DataFrame
    root: DataFrame
    extra: dict = field(default_factory=dict)

    @property
    def dims(self) -> list[tuple[int, ...]]:
        return pyramid_dims(self.meta.lengths, self.depth)


def spans(dim: int, depth: int, start: int = 0) -> list[tuple[int, int]]:
    """(first level, number of levels) of each tile step."""
    out, step = [], TILE_LEVELS[dim]
    while start < depth:
        out.append((start, min(step, depth - start)))
        start, step = start + step, 2 * TILE_LEVELS[dim]
    return out


def keys(dim: int, levels: int, m: str = "m") -> dict[str, Column]:
    """Ancestors 1 to ``levels`` above, as columns ``a1, a2, ...``."""
    return {f"a{j}": ancestor(F.col(m), dim, j) for j in range(1, levels + 1)}


def family_window(levels: int, j: int, by: tuple[str, ...] = ("tile", "var")):
    """The cells below one ancestor j levels up. All these windows of a tile ask for the same partitioning prefix and sort order."""
    part = [*by, *[f"a{i}" for i in range(levels, j - 1, -1)]]
    order = [f"a{i}" for i in range(j - 1, 0, -1)] + ["m"]
    return W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


#: A table and the columns that a step adds to it or replaces in it.
Step = tuple[DataFrame, dict[str, Column]]


class Scheme:
    """A coarsening step and its inverse over window columns. State columns are null on rows that stand for no cell of the level."""

    name: str
    state: tuple[str, ...]

    def __init__(self, kind: Elem):
        self.kind, self.width = kind, kind.width

    def start(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def step(self, df: DataFrame, w, corner: Column, level: int, into: str) -> Step:
        """The table with what the step needs, and its new columns: the state one level up and the level's residual struct.

        Names of helper columns start with an underscore; they go when the tile is done.
        """
        raise NotImplementedError

    def combine(self, bits: Column, length: Column) -> tuple[Column, Column]:
        """(bits, len) of a cell from its parent's and its own ``nbits, payload, symbol``."""
        raise NotImplementedError

    def root(self, df: DataFrame) -> DataFrame:
        return df.select("var", "m", "bits", self.length().alias("len"))

    def length(self) -> Column:
        return F.lit(self.width)


def _residual(level: int, nbits: Column, body: Column, symbol: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), nbits.cast("int").alias("nbits"), body.alias("payload"), symbol.cast("bigint").alias("symbol"))


class PrefixScheme(Scheme):
    """The parent gets the prefix that all its cells share; a cell keeps the rest. Lengths are the symbols."""

    name = "prefix"
    state = ("bits", "len")

    def start(self, df: DataFrame) -> DataFrame:
        if "len" in df.columns:
            return df
        return df.withColumn("len", F.lit(self.width))

    def step(self, df: DataFrame, w, corner: Column, level: int, into: str) -> Step:
        df = df.withColumns({"_or": F.bit_or("bits").over(w), "_and": F.bit_and("bits").over(w), "_least": F.min("len").over(w)})
        df = df.withColumn("_front", family_prefix(F.col("_or"), F.col("_and"), F.col("_least"), self.width))
        rest = F.col("len") - F.col("_front")
        res = _residual(level, rest, payload(F.col("bits"), F.col("_front"), rest, self.width), rest)
        return df, {into: F.when(F.col("bits").isNotNull(), res), "bits": F.when(corner, keep_front(F.col("_or"), F.col("_front"), self.width)), "len": F.when(corner, F.col("_front"))}

    def length(self) -> Column:
        return F.col("len")

    def combine(self, bits: Column, length: Column) -> tuple[Column, Column]:
        shift = F.lit(self.width) - length - F.col("nbits")
        suffix = F.when(F.col("nbits") == 0, long(0)).otherwise(shl(F.col("payload"), shift))
        return bits.bitwiseOR(suffix), length + F.col("nbits")


class _FamilyScheme(Scheme):
    """Schemes that choose a predictor among the members, their mid-range and their mean."""

    state = ("bits", "v")

    def start(self, df: DataFrame) -> DataFrame:
        return df

    def best(self, family: Column, candidates: Column) -> Column:
        raise NotImplementedError

    def predicted(self, df: DataFrame, w, corner: Column) -> DataFrame:
        """Adds the predictor ``_p`` (bits and value) of each row's family."""
        df = df.withColumn("_fam", F.when(corner, F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("bits", "v"))).over(w)))
        values = F.transform("_fam", lambda x: x["v"])  # null but at the corner, so each family's predictor is computed once
        df = df.withColumns({"_mid": array_mid_range(values, self.kind), "_mean": array_mean(values, self.kind)})
        both = [F.struct(to_bits(F.col(c), self.kind).alias("bits"), F.col(c).alias("v")) for c in ("_mid", "_mean")]
        df = df.withColumn("_cand", F.when(corner, F.concat(F.col("_fam"), F.array(*both))))
        fam, cand = F.transform("_fam", lambda x: x["bits"]), F.transform("_cand", lambda x: x["bits"])
        df = df.withColumn("_p", F.when(corner, F.get("_cand", self.best(fam, cand) - 1)))
        return df.withColumns({"_pb": F.max("_p.bits").over(w), "_pv": F.max("_p.v").over(w)})

    def moved(self, corner: Column) -> dict[str, Column]:
        return {"bits": F.when(corner, F.col("_pb")), "v": F.when(corner, F.col("_pv"))}


class MultiResScheme(_FamilyScheme):
    """Predictors that leave most leading zeros in the residuals; the symbol is a residual's count of them and its sign."""

    name = "multires"

    def best(self, family: Column, candidates: Column) -> Column:
        return best_by_zeros(family, candidates, self.width)

    def step(self, df: DataFrame, w, corner: Column, level: int, into: str) -> Step:
        greater, diff = residual(F.col("_pb"), F.col("bits"), self.width)
        df = self.predicted(df, w, corner).withColumns({"_d": diff, "_g": greater}).withColumn("_z", leading_zeros(F.col("_d"), self.width))
        nbits = F.greatest(F.lit(self.width - 1) - F.col("_z"), F.lit(0))
        body = payload(F.col("_d"), F.lit(self.width) - nbits, nbits, self.width)
        res = _residual(level, nbits, body, signed_zeros(F.col("_z"), ~F.col("_g"), self.width))
        return df, {into: F.when(F.col("bits").isNotNull(), res)} | self.moved(corner)

    def combine(self, bits: Column, length: Column) -> tuple[Column, Column]:
        added = F.col("symbol") >= SIGN
        zeros = F.when(added, F.col("symbol") - SIGN).otherwise(F.col("symbol"))
        diff = F.when(zeros >= self.width, long(0)).otherwise(shl(long(1), F.lit(self.width - 1) - zeros).bitwiseOR(F.col("payload")))
        return F.when(added, wrap_add(bits, diff, self.width)).otherwise(wrap_sub(bits, diff, self.width)), length


class XorScheme(_FamilyScheme):
    """Predictors whose XOR residuals share most leading zeros; one four-bit symbol per family (at its first member)."""

    name = "xor"
    MOST = 15

    def __init__(self, kind: Elem):
        if not kind.is_float:
            raise ValueError("the XOR predictor takes float and double")
        super().__init__(kind)

    def best(self, family: Column, candidates: Column) -> Column:
        n = F.size(family)
        return best_by_xor(family, F.get(candidates, n), F.get(candidates, n + 1), self.width)

    def step(self, df: DataFrame, w, corner: Column, level: int, into: str) -> Step:
        df = self.predicted(df, w, corner).withColumn("_x", F.col("bits").bitwiseXOR(F.col("_pb")))
        df = df.withColumn("_z", F.least(leading_zeros(F.bit_or("_x").over(w), self.width), F.lit(self.MOST)))
        res = _residual(level, F.lit(self.width) - F.col("_z"), F.col("_x"), F.when(corner, F.col("_z")))
        return df, {into: F.when(F.col("bits").isNotNull(), res)} | self.moved(corner)

    def combine(self, bits: Column, length: Column) -> tuple[Column, Column]:
        return bits.bitwiseXOR(F.col("payload")), length


SCHEMES: dict[str, type[Scheme]] = {"prefix": PrefixScheme, "multires": MultiResScheme, "xor": XorScheme}


def climb(df: DataFrame, dim: int, start_level: int, levels: int, step: Callable[[DataFrame, object, Column, int, str], Step]) -> DataFrame:
    """``levels`` steps from ``start_level``: one shuffle by tile, one sort. Adds ``r0, r1, ...``, one per step, and ``lead``.

    A parent is represented by its first row (its corner cell, where there is one); ``lead`` marks the rows that stand for a
    node of the level reached.
    """
    df = df.select("var", "m", *[c for c in df.columns if c not in ("var", "m")]).withColumns(keys(dim, levels) | {"lead": F.lit(True)})
    # the finest window comes first, so rows are dealt by tile beforehand; all windows have the tile as their first key
    df = df.withColumn("tile", F.xxhash64("var", f"a{levels}")).repartition("tile")
    for j in range(1, levels + 1):
        w = family_window(levels, j)
        df = df.withColumn("_first", F.min(F.when(F.col("lead"), F.col("m"))).over(w))
        corner = F.col("lead") & (F.col("m") == F.col("_first"))
        df, new = step(df, w, corner, start_level + j - 1, f"r{j - 1}")
        df = df.withColumns(new | {"lead": corner})
    return df.select(*[c for c in df.columns if c[0] != "_" and c != "tile" and c not in keys(dim, levels)])


def _emitted(df: DataFrame, dim: int, levels: int, kind: str = _RES) -> DataFrame:
    """``var, level, m, ...`` rows of the structs in ``r0, r1, ...``."""
    structs = F.array(*[F.when(F.col(f"r{j}").isNotNull(), F.struct(ancestor(F.col("m"), dim, j).alias("m"), F.col(f"r{j}").alias("r"))) for j in range(levels)])
    rows = df.select("var", F.explode(F.filter(structs, lambda x: x.isNotNull())).alias("e"))
    return rows.select("var", F.col("e.r.level").alias("level"), F.col("e.m").alias("m"), *[F.col(f"e.r.{f}").alias(f) for f in _fields(kind)])


def _fields(kind: str) -> list[str]:
    inner = kind[kind.index("<") + 1 : -1]
    return [x.split(":")[0] for x in inner.split(",") if not x.startswith("level:")]


def compress_cells(cells: DataFrame, dim: int, depth: int, scheme: Scheme, meta: GridMeta, folder: str | None = None) -> Pyramid:
    """The pyramid of ``var, m`` and the scheme's state (``bits``, and ``v`` or ``len``) at level 0.

    Each tile step is written to the shared folder, as all but the last are read twice: for their residuals and for the
    cells that go on.
    """
    folder = folder or shared_folder(cells.sparkSession)
    now, parts = scheme.start(cells).select("var", "m", *scheme.state), []
    for level, levels in spans(dim, depth):
        tiles = written(climb(now, dim, level, levels, scheme.step), f"{folder}/tiles-{level}")
        parts.append(_emitted(tiles, dim, levels))
        now = tiles.filter("lead").select("var", ancestor(F.col("m"), dim, levels).alias("m"), *scheme.state)
    residuals = reduce(lambda a, b: a.unionByName(b), parts)
    return Pyramid(scheme.name, meta, depth, residuals, scheme.root(now))


def decompress_cells(pyramid: Pyramid, dim: int, scheme: Scheme, stop: int = 0) -> DataFrame:
    """``var, m, bits, len`` of level ``stop``: per tile of several levels one shuffle and one sort of residuals and their coarse cells."""
    now = pyramid.root.select("var", "m", "bits", F.col("len").cast("int").alias("len"))
    for base, levels in reversed(spans(dim, pyramid.depth, stop)):
        top = base + levels
        none = {"bits": F.lit(None).cast("bigint"), "len": F.lit(None).cast("int")}
        fine = pyramid.residuals.filter((F.col("level") >= base) & (F.col("level") < top)).select("var", (F.col("level") - base).alias("o"), "m", "nbits", "payload", "symbol", *[c.alias(n) for n, c in none.items()])
        coarse = now.select("var", F.lit(levels).alias("o"), "m", F.lit(None).cast("int").alias("nbits"), F.lit(None).cast("bigint").alias("payload"), F.lit(None).cast("bigint").alias("symbol"), "bits", "len")
        rows = fine.unionByName(coarse)
        # a row's ancestor j levels above the base, where it is not above that itself
        rows = rows.withColumns({f"a{j}": F.when(F.col("o") <= j, shr(F.col("m"), F.lit(dim) * F.greatest(F.lit(j) - F.col("o"), F.lit(0)))).otherwise(long(-1)) for j in range(1, levels + 1)})
        for j in range(levels - 1, -1, -1):
            part = ["var", *[f"a{i}" for i in range(levels, j, -1)]]
            w = W.partitionBy(*part).orderBy(*[f"a{i}" for i in range(j, 0, -1)], "o").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            parent = F.col("o") == j + 1
            rows = rows.withColumns({"_b": F.max(F.when(parent, F.col("bits"))).over(w), "_l": F.max(F.when(parent, F.col("len"))).over(w)})
            bits, length = scheme.combine(F.col("_b"), F.col("_l"))
            here = F.col("o") == j
            rows = rows.withColumns({"bits": F.when(here, bits).otherwise(F.col("bits")), "len": F.when(here, length).otherwise(F.col("len"))}).drop("_b", "_l")
        now = rows.filter(F.col("o") == 0).select("var", "m", "bits", "len")
    return now


def cells_of(grid: Grid) -> DataFrame:
    """``var, m, bits, v`` of a grid's cells."""
    kind = grid.meta.elem
    m = morton_of(grid.axes, grid.meta.domain.starts(grid.meta.layout))
    return grid.df.select("var", m.alias("m"), to_bits(F.col("value"), kind).alias("bits"), F.col("value").alias("v"))


def compress(grid: Grid, scheme: str = "prefix", folder: str | None = None) -> Pyramid:
    """Lossless compression of a dense grid of 1 to 4 dimensions: ``prefix``, ``multires`` or ``xor`` (float and double)."""
    return compress_cells(cells_of(grid), grid.meta.dimensionality, grid.meta.depth, SCHEMES[scheme](grid.meta.elem), grid.meta, folder)


def grid_from_cells(cells: DataFrame, meta: GridMeta) -> Grid:
    """A grid from ``var, m, bits``."""
    layout, starts = meta.layout, meta.domain.starts(meta.layout)
    parts = [*reversed(morton_decode(F.col("m"), len(layout.axes)))]
    coords = {a: c + s if s else c for a, c, s in zip(layout.axes, parts, starts, strict=True)}
    value = from_bits(F.col("bits"), meta.elem)
    return Grid(cells.select("var", *[coords.get(a, long(0)).cast("long").alias(a) for a in COORDS], value.alias("value")), meta)


def decompress(pyramid: Pyramid) -> Grid:
    """The grid again, bit by bit."""
    scheme = SCHEMES[pyramid.scheme](pyramid.meta.elem)
    return grid_from_cells(decompress_cells(pyramid, pyramid.meta.dimensionality, scheme).select("var", "m", "bits"), pyramid.meta)


def mean_levels(grid: Grid, depth: int | None = None) -> DataFrame:
    """``var, level, m, value``: at each level above the cells the mean of each family of the level below, in the element type."""
    kind, dim = grid.meta.elem, grid.meta.dimensionality
    depth = grid.meta.depth if depth is None else depth

    def step(df: DataFrame, w, corner: Column, level: int, into: str) -> Step:
        df = df.withColumn("_mean", F.avg(F.col("v").cast("double")).over(w).cast(kind.spark))
        return df, {"v": F.when(corner, F.col("_mean")), into: F.when(corner, F.struct(F.lit(level + 1).alias("level"), F.col("_mean").alias("value")))}

    now, parts, folder = with_values(grid), [], shared_folder(grid.df.sparkSession)
    for level, levels in spans(dim, depth):
        tiles = written(climb(now, dim, level, levels, step), f"{folder}/means-{level}")
        structs = F.array(*[F.when(F.col(f"r{j}").isNotNull(), F.struct(ancestor(F.col("m"), dim, j + 1).alias("m"), F.col(f"r{j}").alias("r"))) for j in range(levels)])
        parts.append(tiles.select("var", F.explode(F.filter(structs, lambda x: x.isNotNull())).alias("e")).select("var", F.col("e.r.level").alias("level"), F.col("e.m").alias("m"), F.col("e.r.value").alias("value")))
        now = tiles.filter("lead").select("var", ancestor(F.col("m"), dim, levels).alias("m"), "v")
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_values(grid: Grid) -> DataFrame:
    m = morton_of(grid.axes, grid.meta.domain.starts(grid.meta.layout))
    return grid.df.select("var", m.alias("m"), F.col("value").alias("v"))


def coarsen(grid: Grid, interpolation: Callable[[Column], Column]) -> Grid:
    """One coarsening step by any interpolation: cells grouped by halved coordinates (relative to the domain's start)."""
    meta = grid.meta
    starts = dict(zip(meta.layout.axes, meta.domain.starts(meta.layout), strict=True))
    halves = [F.call_function("div", F.col(a) - starts.get(a, 0), long(2)).alias(a) for a in COORDS]
    df = grid.df.select("var", *halves, "value").groupBy("var", *COORDS).agg(interpolation(F.col("value")).alias("value"))
    return Grid(df, meta.but(domain=Domain.default(meta.layout, [-(-n // 2) for n in meta.lengths])))
