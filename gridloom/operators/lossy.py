"""Error-bounded compression: adaptive coarsening, tail truncation, trimmed and quantized residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import truncation
from gridloom.functions.bits import leading_zeros, long, payload, shl, shr, to_bits, trailing_zeros, wrap_add, wrap_sub
from gridloom.functions.coords import ancestor, in_domain, morton_decode, morton_of
from gridloom.functions.deviation import absolute, complies, relative
from gridloom.functions.families import approx_equal, unless_missing
from gridloom.functions.symbols import SIGN, quantized, residual_bin, signed_zeros
from gridloom.operators.grid import Grid
from gridloom.operators.pyramid import MultiResScheme, PrefixScheme, Pyramid, Step, climb, compress_cells, decompress_cells, grid_from_cells, spans
from gridloom.plans.domain import COORDS, GridMeta
from gridloom.plans.errors import ErrorRules
from gridloom.plans.storage import shared_folder, written


def bounded_cells(grid: Grid, rules: ErrorRules) -> DataFrame:
    """``var, m, v, abs_eps, rel_eps`` of a grid's cells: every cell has the bounds of its own place."""
    m = morton_of(grid.axes, grid.meta.domain.starts(grid.meta.layout))
    return rules.restricting(grid.df).select("var", m.alias("m"), F.col("value").alias("v"), "abs_eps", "rel_eps")


# --- adaptive coarsening -------------------------------------------------------------------------------------------


def adaptive_coarsening(grid: Grid, rules: ErrorRules, skip_missing: bool = True, mid_range: bool = False, depth: int | None = None) -> DataFrame:
    """The elements that are left (``var, level, m, value, err``) when families merge as long as all bounds hold.

    A family merges if all its places are single elements and each member's deviation from the interpolated value,
    with what was introduced before, complies with the least bounds of its cells; ``err`` is the largest absolute error
    introduced so far. An element that does not merge stays, and so do all its ancestors' families.
    """
    meta, kind = grid.meta, grid.meta.elem
    dim, depth = meta.dimensionality, meta.depth if depth is None else depth
    gap = lambda v: approx_equal(v, F.lit(meta.missing).cast(kind.spark), kind) if skip_missing else F.lit(False)

    def interpolated(w) -> Column:
        v = unless_missing(F.col("v"), meta.missing, kind) if skip_missing else F.col("v")
        if mid_range:
            both = (F.max(v).over(w).cast("double") + F.min(v).over(w).cast("double")) / 2
        else:
            both = F.avg(v.cast("double")).over(w)
        return F.coalesce(both.cast(kind.spark), F.lit(meta.missing).cast(kind.spark))

    def step(df: DataFrame, w, corner: Column, level: int, into: str) -> Step:
        df = df.withColumns({"_c": interpolated(w), "_n": F.count("v").over(w), "_places": F.count_if("lead").over(w)})
        dev = F.when(gap(F.col("v")), F.lit(0.0)).otherwise(absolute(F.col("v"), F.col("_c"), F.col("err")))
        rel = F.when(gap(F.col("v")), F.lit(0.0)).otherwise(relative(F.col("v"), F.col("_c"), F.col("err")))
        df = df.withColumns({"_dev": dev, "_ok": complies(dev, rel, F.col("abs_eps"), F.col("rel_eps"))})
        df = df.withColumns({"_all": F.bool_and(F.when(F.col("v").isNotNull(), F.col("_ok"))).over(w) & (F.col("_n") == F.col("_places")), "_most": F.max("_dev").over(w), "_abs": F.min("abs_eps").over(w), "_rel": F.min("rel_eps").over(w)})
        stays = F.when(F.col("v").isNotNull() & ~F.col("_all"), F.struct(F.lit(level).alias("level"), F.col("v").alias("value"), F.col("err").alias("err")))
        up = corner & F.col("_all")
        return df, {into: stays} | {c: F.when(up, F.col(n)) for c, n in {"v": "_c", "err": "_most", "abs_eps": "_abs", "rel_eps": "_rel"}.items()}

    state = ("v", "err", "abs_eps", "rel_eps")
    now = bounded_cells(grid, rules).withColumn("err", F.lit(0.0)).select("var", "m", *state)
    folder, parts = shared_folder(grid.df.sparkSession), []
    for level, levels in spans(dim, depth):
        tiles = written(climb(now, dim, level, levels, step), f"{folder}/coarse-{level}")
        structs = F.array(*[F.when(F.col(f"r{j}").isNotNull(), F.struct(ancestor(F.col("m"), dim, j).alias("m"), F.col(f"r{j}").alias("r"))) for j in range(levels)])
        parts.append(tiles.select("var", F.explode(F.filter(structs, lambda x: x.isNotNull())).alias("e")).select("var", F.col("e.r.level").alias("level"), F.col("e.m").alias("m"), F.col("e.r.value").alias("value"), F.col("e.r.err").alias("err")))
        now = tiles.filter("lead").select("var", ancestor(F.col("m"), dim, levels).alias("m"), *state)
    top = now.filter(F.col("v").isNotNull()).select("var", F.lit(depth).alias("level"), "m", F.col("v").alias("value"), "err")
    return reduce(lambda a, b: a.unionByName(b), [*parts, top])


def expand_elements(elements: DataFrame, meta: GridMeta, most_levels: int = 4) -> Grid:
    """The grid of elements (``var, level, m, value``): every cell has its element's value.

    Large elements are cut in steps, with a shuffle in between, so that no task makes all cells of one.
    """
    dim = meta.dimensionality
    rows, level = elements.select("var", "level", "m", "value"), meta.depth
    while level:
        base = max(0, level - most_levels)
        span = F.greatest(F.col("level") - base, F.lit(0))
        children = F.sequence(long(0), shl(long(1), F.lit(dim) * span) - 1)
        rows = rows.select("var", F.least("level", F.lit(base)).alias("level"), (shl(F.col("m"), F.lit(dim) * span)).alias("m0"), F.explode(children).alias("c"), "value")
        rows = rows.select("var", "level", (F.col("m0") + F.col("c")).alias("m"), "value")
        level = base
        if level:
            rows = rows.repartition("var", "m")
    layout, starts = meta.layout, meta.domain.starts(meta.layout)
    parts = [*reversed(morton_decode(F.col("m"), dim))]
    coords = {a: c + s for a, c, s in zip(layout.axes, parts, starts, strict=True)}
    cells = rows.select("var", *[coords.get(a, long(0)).cast("long").alias(a) for a in COORDS], "value")
    return Grid(cells.filter(in_domain(layout, meta.domain)), meta)


# --- tail truncation before prefix extraction ---------------------------------------------------------------------

def truncated_cells(grid: Grid, rules: ErrorRules) -> DataFrame:
    """``var, m, bits, len`` after tail truncation of each cell under its own bounds."""
    kind, missing = grid.meta.elem, grid.meta.missing
    m = morton_of(grid.axes, grid.meta.domain.starts(grid.meta.layout))
    rows = rules.restricting(grid.df).select("var", m.alias("m"), "value", "abs_eps", "rel_eps")
    if kind.name == "uint64":
        raise ValueError("tail truncation takes types of up to 64 bits that Spark holds as numbers")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bits = truncation.as_bits(np.asarray(b.column(2)), kind)
            eps = [np.asarray(b.column(k).fill_null(np.nan), np.float64) for k in (3, 4)]
            out, n = truncation.truncate_tails(bits, kind, *eps, missing)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array(n.astype(np.int32))], names=["var", "m", "bits", "len"])

    return rows.mapInArrow(run, "var string, m long, bits long, len int")


def compress_quantized_prefix(grid: Grid, rules: ErrorRules) -> Pyramid:
    """Prefix extraction of truncated cells: every restored cell is within its bounds."""
    pyramid = compress_cells(truncated_cells(grid, rules), grid.meta.dimensionality, grid.meta.depth, PrefixScheme(grid.meta.elem), grid.meta)
    return replace(pyramid, scheme="quantized_prefix")


def decompress_quantized_prefix(pyramid: Pyramid) -> Grid:
    kind, width = pyramid.meta.elem, pyramid.meta.elem.width
    cells = decompress_cells(pyramid, pyramid.meta.dimensionality, PrefixScheme(kind))
    place = F.lit(width - 1) - F.col("len")
    implied = F.when((F.col("len") > 0) & (F.col("len") < width), F.col("bits").bitwiseOR(shl(long(1), F.greatest(place, F.lit(0))))).otherwise(F.col("bits"))
    return grid_from_cells(cells.select("var", "m", implied.alias("bits")), pyramid.meta)


# --- trimmed residuals ---------------------------------------------------------------------------------------------

class TrimmedScheme(MultiResScheme):
    """Residuals between an implied first and an implied last one: symbols are leading zeros with the sign, then trailing zeros."""

    name = "trimmed"

    def combine(self, bits: Column, length: Column) -> tuple[Column, Column]:
        added = F.col("symbol") >= SIGN
        zeros = F.when(added, F.col("symbol") - SIGN).otherwise(F.col("symbol")).cast("int")
        first = F.when(zeros >= self.width, long(0)).otherwise(shl(long(1), F.greatest(F.lit(self.width - 1) - zeros, F.lit(0))))
        tail = F.col("tail")
        both = first.bitwiseOR(F.when(tail + 1 + zeros < self.width, shl(long(1), tail)).otherwise(long(0)))
        body = F.when(F.col("nbits") > 0, shl(F.col("payload"), tail + 1)).otherwise(long(0))
        diff = F.when(zeros >= self.width, long(0)).otherwise(both.bitwiseOR(body))
        return F.when(added, wrap_add(bits, diff, self.width)).otherwise(wrap_sub(bits, diff, self.width)), length


def _predictors(grid: Grid, rules: ErrorRules, folder: str) -> list[DataFrame]:
    """Per tile step a table ``var, m, abs_eps, rel_eps, bits, p0, p1, ...``: cells, and the predictors of the levels above at their corner cells."""
    kind, dim, depth = grid.meta.elem, grid.meta.dimensionality, grid.meta.depth
    scheme = MultiResScheme(kind)

    def step(df: DataFrame, w, corner: Column, level: int, into: str) -> Step:
        df = scheme.predicted(df, w, corner).withColumns({"_abs": F.min("abs_eps").over(w), "_rel": F.min("rel_eps").over(w)})
        up = {"bits": F.col("_pb"), "abs_eps": F.col("_abs"), "rel_eps": F.col("_rel")}
        made = F.when(corner, F.struct(*[c.alias(n) for n, c in up.items()]))
        return df, {into: made, "v": F.when(corner, F.col("_pv"))} | {n: F.when(corner, c) for n, c in up.items()}

    m = morton_of(grid.axes, grid.meta.domain.starts(grid.meta.layout))
    now = rules.restricting(grid.df).select("var", m.alias("m"), to_bits(F.col("value"), kind).alias("bits"), F.col("value").alias("v"), "abs_eps", "rel_eps")
    out = []
    for level, levels in spans(dim, depth):
        held = now.withColumn("own", F.struct("bits", "abs_eps", "rel_eps"))
        tiles = written(climb(held, dim, level, levels, step), f"{folder}/predictors-{level}")
        out.append(tiles)
        now = tiles.filter("lead").select("var", ancestor(F.col("m"), dim, levels).alias("m"), "bits", "v", "abs_eps", "rel_eps")
    return out


def compress_trimmed(grid: Grid, rules: ErrorRules) -> Pyramid:
    """Predictors as in the lossless multi-resolution scheme, residuals trimmed under the bounds.

    Predictors are found on the way up; residuals are taken on the way down against what a decoder has by then, so errors
    of coarse levels don't add up and every cell keeps its own bound. Trimming is the only part that runs in Python.
    """
    kind, dim, depth, width = grid.meta.elem, grid.meta.dimensionality, grid.meta.depth, grid.meta.elem.width
    if kind.name == "uint64":
        raise ValueError("trimmed residuals take types of up to 64 bits that Spark holds as numbers")
    folder = shared_folder(grid.df.sparkSession)
    tables = _predictors(grid, rules, folder)
    levels = spans(dim, depth)[-1][1]
    root = tables[-1].filter("lead").select("var", ancestor(F.col("m"), dim, levels).alias("m"), "bits", F.lit(width).alias("len"))
    coarse, parts = root.select("var", "m", "bits"), []

    def trim(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            approx, real = (np.asarray(b.column(k).cast(pa.int64())) for k in (2, 3))
            eps = [np.asarray(b.column(k).fill_null(np.nan), np.float64) for k in (4, 5)]
            less, diff, now = truncation.minimal_residuals(approx.copy(), real.copy(), kind, *eps)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(less), pa.array(diff), pa.array(now)], names=["var", "m", "less", "diff", "bits"])

    for (base, levels), tiles in reversed([*zip(spans(dim, depth), tables, strict=True)]):
        for j in range(levels - 1, -1, -1):
            # the cells of level base + j against their parents as restored
            source = F.col("own") if j == 0 else F.col(f"r{j - 1}")
            real = tiles.select("var", ancestor(F.col("m"), dim, j).alias("m"), source.alias("s")).filter(F.col("s").isNotNull())
            real = real.select("var", "m", shr(F.col("m"), dim).alias("up"), F.col("s.bits").alias("real"), F.col("s.abs_eps").alias("abs_eps"), F.col("s.rel_eps").alias("rel_eps"))
            pairs = real.join(coarse.select("var", F.col("m").alias("up"), F.col("bits").alias("approx")), ["var", "up"])
            done = pairs.select("var", "m", "approx", "real", "abs_eps", "rel_eps").mapInArrow(trim, "var string, m long, less boolean, diff long, bits long")
            done = written(done, f"{folder}/trimmed-{base + j}")
            parts.append(done.withColumn("level", F.lit(base + j)))
            coarse = done.select("var", "m", "bits")
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    rows = rows.withColumns({"_z": leading_zeros(F.col("diff"), width), "tail": trailing_zeros(F.col("diff"), width)})
    nbits = F.greatest(F.lit(width - 2) - F.col("_z") - F.col("tail"), F.lit(0))
    body = payload(F.col("diff"), F.col("_z") + 1, nbits, width)
    residuals = rows.select("var", "level", "m", nbits.cast("int").alias("nbits"), body.alias("payload"), signed_zeros(F.col("_z"), ~F.col("less"), width).alias("symbol"), F.col("tail").cast("int").alias("tail"))
    return Pyramid("trimmed", grid.meta, depth, residuals, root)


def trimmed_symbols(pyramid: Pyramid) -> DataFrame:
    """``var, level, m, k, symbol``: leading zeros with the sign first; then trailing zeros, unless the first symbol says all."""
    width = pyramid.meta.elem.width
    zeros = F.when(F.col("symbol") >= SIGN, F.col("symbol") - SIGN).otherwise(F.col("symbol"))
    second = F.when(zeros < width - 1, F.col("tail").cast("long"))
    return pyramid.residuals.select("var", "level", "m", F.posexplode(F.array(F.col("symbol"), second)).alias("k", "symbol")).filter(F.col("symbol").isNotNull())


#: Levels that are restored between two written tables.
_WRITTEN = 2


def decompress_trimmed(pyramid: Pyramid) -> Grid:
    """Restores by one equi-join per level; tables of the coarse side shrink with each level up.

    Every few levels the table is written, as each level puts the expressions of all above it into its own.
    """
    scheme, dim = TrimmedScheme(pyramid.meta.elem), pyramid.meta.dimensionality
    now, folder = pyramid.root.select("var", "m", "bits"), shared_folder(pyramid.root.sparkSession)
    for level in range(pyramid.depth - 1, -1, -1):
        fine = pyramid.residuals.filter(F.col("level") == level).withColumn("up", shr(F.col("m"), dim))
        pairs = fine.join(now.select("var", F.col("m").alias("up"), F.col("bits").alias("_b")), ["var", "up"])
        now = pairs.select("var", "m", scheme.combine(F.col("_b"), F.lit(pyramid.meta.elem.width))[0].alias("bits"))
        if level and (pyramid.depth - level) % _WRITTEN == 0:
            now = written(now, f"{folder}/restored-{level}")
    return grid_from_cells(now, pyramid.meta)


# --- quantized residuals -------------------------------------------------------------------------------------------

def quantize_residuals(pairs: DataFrame, bound: float, budget: Column | float | None = None) -> DataFrame:
    """Adds ``residual`` and its code ``bin`` to ``value, prediction``; residuals within the budget (the bound by default) are 0."""
    residual = F.col("value").cast("double") - F.col("prediction").cast("double")
    rows = pairs.withColumn("residual", residual)
    return rows.withColumn("bin", quantized(F.col("residual"), bound, bound if budget is None else budget))


def residual_histogram(pairs: DataFrame, step: float, bins: int = 10, factor: int = 1) -> DataFrame:
    """``bin, n`` of residuals by multiples of the step; beyond ``bins`` they are outliers. ``factor`` 2 takes bins of twice the width."""
    residual = F.col("value").cast("double") - F.col("prediction").cast("double")
    return pairs.select(residual_bin(residual, step * factor, bins).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def remaining_budget(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The family's budget for what follows: the least of ``budget - |residual|`` of members within their budget; null where none is."""
    left = F.col("budget") - F.abs("residual")
    return rows.groupBy(*by).agg(F.min(F.when(left >= 0, left)).alias("budget"))
