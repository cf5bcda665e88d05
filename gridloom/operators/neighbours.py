"""Neighbour access and predictors: values at fixed offsets, without a join per offset.

Cells are dealt out by blocks, each with its halo, so about one copy of a cell moves however many neighbours are asked for;
within a block cells hand their values to those that ask.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.bits import abs_difference, leading_zeros, long, shr, to_bits
from gridloom.functions.coords import morton_of
from gridloom.functions.families import array_mean, array_mid_range
from gridloom.operators.grid import Grid
from gridloom.operators.pyramid import coarsen
from gridloom.plans.domain import COORDS, Domain
from gridloom.plans.storage import shared_folder, written

#: Side of a block of cells.
BLOCK = 32
Offset = dict[str, int]


def stencil(grid: Grid, offsets: dict[str, Offset], block: int = BLOCK) -> DataFrame:
    """``var, t, z, y, x, value`` and for each named offset the value there, null where there is no cell.

    An offset names axes, as ``{"x": -1}``. One shuffle of the cells with the halo of their block.
    """
    domain, layout = grid.meta.domain, grid.meta.layout
    axes = {a: domain.interval(d) for d, a in zip(layout.dims, layout.axes, strict=True)}

    def target(o: Offset) -> dict[str, Column]:
        return {a: F.col(a) - o[a] if o.get(a) else F.col(a) for a in axes}

    def inside(c: dict[str, Column], o: Offset) -> Column:
        terms = [(c[a] >= axes[a][0]) & (c[a] < axes[a][1]) for a in axes if o.get(a)]
        return reduce(lambda p, q: p & q, terms, F.lit(True))

    def block_of(c: dict[str, Column]) -> Column:
        index = long(0)
        for a, (start, end) in axes.items():
            index = index * (-(-(end - start) // block)) + F.call_function("div", c[a] - start, long(block))
        return index

    every = {"": {}} | offsets
    blocks = F.array(*[F.when(inside(target(o), o), block_of(target(o))) for o in every.values()])
    rows = grid.df.withColumn("block", F.explode(F.array_distinct(F.filter(blocks, lambda b: b.isNotNull()))))
    rows = rows.repartition("var", "block")
    sent = F.array(*[F.when(inside(target(o), o), F.struct(F.lit(k).alias("k"), block_of(target(o)).alias("b"), *[target(o)[a].alias(a) for a in axes])) for k, o in enumerate(every.values())])
    rows = rows.select("var", "block", "value", F.explode(F.filter(sent, lambda s: s.isNotNull())).alias("s")).filter(F.col("s.b") == F.col("block"))
    rows = rows.select("var", "block", *[(F.col(f"s.{a}") if a in axes else long(0)).alias(a) for a in COORDS], F.col("s.k").alias("k"), "value")
    names = ["value", *offsets]
    found = rows.groupBy("var", "block", *COORDS).agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(n) for k, n in enumerate(names)], F.bool_or(F.col("k") == 0).alias("_own"))
    return found.filter("_own").drop("_own", "block")


def face_offsets(grid: Grid) -> dict[str, Offset]:
    """``f0`` (lower) and ``f1`` (upper) along x, ``f2`` and ``f3`` along y, and so on."""
    grid = grid.along_curve
    return {f"f{2 * k + s}": {a: 2 * s - 1} for k, a in enumerate(reversed(grid.axes)) for s in (0, 1)}


def face_neighbours(grid: Grid) -> DataFrame:
    """Values across all faces; ``faces`` is their number, ``in_family`` how many of them share the cell's parent."""
    grid = grid.along_curve
    offsets = face_offsets(grid)
    out = stencil(grid, offsets)
    starts = dict(zip(grid.axes, grid.meta.domain.starts(grid.meta.layout), strict=True))
    there = {n: F.when(F.col(n).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for n in offsets}
    # along each axis the one face that looks into the family
    kin = []
    for k, a in enumerate(reversed(grid.axes)):
        odd = (F.col(a) - starts[a]) % 2 == 1
        kin.append(F.when(odd, there[f"f{2 * k}"]).otherwise(there[f"f{2 * k + 1}"]))
    return out.withColumns({"faces": reduce(lambda p, q: p + q, there.values()), "in_family": reduce(lambda p, q: p + q, kin)})


def lorenzo_offsets(axes: tuple[str, ...]) -> list[tuple[int, dict[str, int]]]:
    """(sign, offset) of all corners of the unit box before a cell: plus for an odd number of steps back."""
    out = []
    for steps in product((0, 1), repeat=len(axes)):
        if any(steps):
            out.append((1 if sum(steps) % 2 else -1, {a: -1 for a, s in zip(axes, steps, strict=True) if s}))
    return sorted(out, key=lambda x: (-x[0], -len(x[1]), [-x[1].get(a, 0) for a in axes]))


def lorenzo(grid: Grid, rel_err: float = 1e-6) -> DataFrame:
    """Lorenzo prediction of interior cells from original values: adds ``prediction, residual`` and ``zero`` (within the relative error)."""
    corners = lorenzo_offsets(grid.axes)
    rows = stencil(grid, {f"n{k}": o for k, (_, o) in enumerate(corners)})
    rows = rows.filter(reduce(lambda p, q: p & q, [F.col(f"n{k}").isNotNull() for k in range(len(corners))]))
    plus = [F.col(f"n{k}") for k, (s, _) in enumerate(corners) if s > 0]
    minus = [F.col(f"n{k}") for k, (s, _) in enumerate(corners) if s < 0]
    prediction = reduce(lambda p, q: p - q, minus, reduce(lambda p, q: p + q, plus))
    rows = rows.withColumn("prediction", prediction.cast("double"))
    v = F.col("value").cast("double")
    rows = rows.withColumn("residual", v - F.col("prediction"))
    zero = F.when(v == 0, F.col("residual") == 0).otherwise(F.abs(F.col("residual") / F.nullif(v, F.lit(0.0))) <= rel_err)
    return rows.withColumn("zero", zero).select("var", *COORDS, "value", "prediction", "residual", "zero")


def lorenzo_summary(rows: DataFrame) -> DataFrame:
    """One row: cells predicted, residuals within the error, RMSE."""
    return rows.agg(F.count("*").alias("n"), F.count_if("zero").alias("zeros"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))


#: Cells of a block that ``lorenzo_feedback`` walks.
_WALKED = 1 << 19


def _walked_sides(shape: tuple[int, ...]) -> list[int]:
    """Sides of blocks of about that many cells: short axes whole, the others alike, so that long grids have few waves."""
    sides, left = [1] * len(shape), _WALKED
    order = sorted(range(len(shape)), key=lambda k: shape[k])
    for at, k in enumerate(order):
        sides[k] = max(1, min(shape[k], round(left ** (1 / (len(order) - at)))))
        left //= sides[k]
    return sides


def lorenzo_feedback(grid: Grid, rel_err: float = 1e-6, block: int | None = None) -> DataFrame:
    """Lorenzo prediction where values within the error are replaced at once and predict the next ones: adds ``restored`` and ``zero``.

    The first planes of the grid predict, but are not predicted; all other cells are. As a replacement changes what
    all cells behind it are predicted from, blocks are walked in waves: those whose places add up to the same number
    don't depend on each other, and each is handed the restored planes before it, which earlier waves have written. Within
    a block the cells of an anti-diagonal are taken at once. There are as many waves as blocks along all axes together, so blocks
    are large and as long as the grid is.
    """
    axes, meta, spark = grid.axes, grid.meta, grid.df.sparkSession
    starts, shape = meta.domain.starts(meta.layout), meta.domain.lengths(meta.layout)
    sizes = [block] * len(axes) if block else _walked_sides(shape)
    kind, folder = meta.elem, shared_folder(spark)
    names = [f"b_{a}" for a in axes]
    within = dict(zip(axes, [(F.col(a) - s) % n for a, s, n in zip(axes, starts, sizes, strict=True)], strict=True))
    corners = [(s, [o.get(a, 0) for a in axes]) for s, o in lorenzo_offsets(axes)]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        base = [pdf[b].iloc[0] * n + s - 1 for b, s, n in zip(names, starts, sizes, strict=True)]
        at = [pdf[a].to_numpy() - o for a, o in zip(axes, base, strict=True)]
        data = np.full([x.max() + 1 for x in at], np.nan, np.float64)  # the first of each axis: what lies before the block
        data[tuple(at)] = pdf["restored"].to_numpy(dtype=np.float64)
        flat, zero = data.reshape(-1), np.zeros(data.size, bool)
        strides = np.array(data.strides) // data.itemsize
        inner = np.indices([n - 1 for n in data.shape]).reshape(len(axes), -1) + 1
        diagonal, place = inner.sum(axis=0), strides @ inner
        order = np.argsort(diagonal, kind="stable")
        steps = [(s, int(strides @ np.array(o))) for s, o in corners]
        for cells in np.split(place[order], np.flatnonzero(np.diff(diagonal[order])) + 1):
            p = sum(s * flat[cells + o] for s, o in steps)
            v = flat[cells]
            hit = np.abs(p - v) <= rel_err * np.abs(v)  # never where a value is lacking
            flat[cells[hit]] = p[hit].astype(kind.numpy)
            zero[cells[hit]] = True
        own = ~pdf["before"].to_numpy()
        spot = tuple(x[own] for x in at)
        return pdf.loc[own, ["var", *COORDS, *names, "value"]].assign(restored=data[spot].astype(kind.numpy), zero=zero.reshape(data.shape)[spot])

    columns = f"var string, t long, z long, y long, x long, {', '.join(f'{b} long' for b in names)}, value {kind.spark}"
    index = [F.call_function("div", F.col(a) - s, long(n)).alias(b) for a, b, s, n in zip(axes, names, starts, sizes, strict=True)]
    cells = grid.df.select("var", *COORDS, *index, "value").withColumn("wave", reduce(lambda p, q: p + q, [F.col(b) for b in names]).cast("int"))
    cells.write.partitionBy("wave").parquet(f"{folder}/cells")
    cells = spark.read.schema(f"{columns}, wave int").parquet(f"{folder}/cells")
    done: list[DataFrame] = []
    for wave in range(sum((n - 1) // size for n, size in zip(shape, sizes, strict=True)) + 1):
        rows = cells.filter(F.col("wave") == wave).withColumns({"restored": F.col("value"), "before": F.lit(False)}).drop("wave")
        for ahead in product((0, 1), repeat=len(axes)):
            if 0 < sum(ahead) <= wave:  # the last planes of the block that lies one step before along these axes
                last = reduce(lambda p, q: p & q, [within[a] == n - 1 for a, s, n in zip(axes, ahead, sizes, strict=True) if s])
                plane = done[wave - sum(ahead)].filter(last).withColumns({b: F.col(b) + s for b, s in zip(names, ahead, strict=True)} | {"before": F.lit(True)})
                rows = rows.unionByName(plane.select(*rows.columns))
        done.append(written(rows.groupBy("var", *names).applyInPandas(_only_own(walk), f"{columns}, restored {kind.spark}, zero boolean"), f"{folder}/done/wave={wave}"))
    return spark.read.schema(done[0].schema).parquet(f"{folder}/done").select("var", *COORDS, "value", "restored", "zero")


def _only_own(walk: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``walk`` for groups that have cells of their own; what lies before a block that has none predicts nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["before"].all():
            return pdf.iloc[:0].drop(columns="before").assign(zero=pd.Series([], dtype=bool))
        return walk(pdf)

    return run


# --- reconstruction of fine values from coarse ones and their faces ------------------------------------------------

def _parents(grid: Grid) -> dict[str, Column]:
    starts = dict(zip(grid.axes, grid.meta.domain.starts(grid.meta.layout), strict=True))
    return {a: F.call_function("div", F.col(a) - starts.get(a, 0), long(2)) for a in COORDS}


def _child_bit(grid: Grid, axis: str) -> Column:
    return (F.col(axis) - grid.meta.domain.starts(grid.meta.layout)[grid.axes.index(axis)]) % 2


def with_parent(grid: Grid, coarse: DataFrame) -> DataFrame:
    """Fine cells (``var, t, z, y, x, value``) with the columns of their parent in a coarse table."""
    up = {a: f"p_{a}" for a in COORDS}
    right = coarse.select("var", *[F.col(a).alias(up[a]) for a in COORDS], *[c for c in coarse.columns if c not in ("var", *COORDS)])
    return grid.df.withColumns({up[a]: c for a, c in _parents(grid).items()}).join(right, ["var", *up.values()]).drop(*up.values())


def mirrored_faces(coarse: Grid) -> DataFrame:
    """Coarse cells as ``coarse`` with all faces; a face at the border holds its opposite's value, without either the cell's own."""
    offsets = face_offsets(coarse)
    rows = stencil(coarse, offsets)
    fill = {n: F.coalesce(F.col(n), F.col(f"f{int(n[1:]) ^ 1}"), F.col("value")) for n in offsets}
    return rows.select("var", *COORDS, F.col("value").alias("coarse"), *[c.alias(n) for n, c in fill.items()])


def face_prediction(grid: Grid, interpolation: Callable[[Column], Column], weights: tuple[float, float, float] | None = None) -> DataFrame:
    """Fine values predicted from the coarse value and the faces of its cell: ``var, t, z, y, x, value, prediction``.

    ``weights`` (coarse, near face, far face) as (1/5, 1/6, 1/10) in three dimensions; without them the mean of the coarse
    value and the near faces. A child's place in its family says which face is near.
    """
    grid = grid.along_curve
    return predicted_by_faces(grid, coarsen(grid, interpolation), weights)


def predicted_by_faces(grid: Grid, coarse: Grid, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """As ``face_prediction``, from a coarse grid that is there already; of the fine one its cells count, not their values."""
    rows = with_parent(grid, mirrored_faces(coarse))
    near, far = [], []
    for k, a in enumerate(reversed(grid.axes)):
        upper = _child_bit(grid, a) == 1
        low, high = F.col(f"f{2 * k}").cast("double"), F.col(f"f{2 * k + 1}").cast("double")
        near.append(F.when(upper, high).otherwise(low))
        far.append(F.when(upper, low).otherwise(high))
    add = lambda xs: reduce(lambda p, q: p + q, xs)
    own = F.col("coarse").cast("double")
    if weights is None:
        prediction = add([own, *near]) / (len(near) + 1)
    else:
        wc, wn, wf = weights
        prediction = add([own * wc, *[n * wn for n in near], *[f * wf for f in far]])
    return rows.select("var", *COORDS, "value", prediction.cast(grid.meta.elem.spark).alias("prediction"))


HEX_WEIGHTS = (1 / 5, 1 / 6, 1 / 10)


def first_children(grid: Grid) -> Grid:
    """Per family the value of its first child."""
    starts = dict(zip(grid.axes, grid.meta.domain.starts(grid.meta.layout), strict=True))
    even = reduce(lambda p, q: p & q, [(F.col(a) - s) % 2 == 0 for a, s in starts.items()])
    df = grid.df.filter(even).select("var", *[c.alias(a) for a, c in _parents(grid).items()], "value")
    return Grid(df, grid.meta.but(domain=Domain.default(grid.meta.layout, [-(-n // 2) for n in grid.meta.lengths])))


def idw_prediction(grid: Grid, samples: Grid | None = None, power: int = 16) -> DataFrame:
    """Inverse-distance weighting from the coarse sample of a cell's family and those across its faces.

    A sample is the first child's value at that child's centre (``samples`` may hold a changed one, as after truncation);
    at a distance of 0 the sample itself is the prediction.
    """
    grid = grid.along_curve
    coarse = samples or first_children(grid)
    offsets = face_offsets(coarse)
    rows = with_parent(grid, stencil(coarse, offsets).withColumnRenamed("value", "coarse"))
    bits = {a: _child_bit(grid, a).cast("double") for a in grid.axes}

    def weight(offset: Offset) -> Column:
        squares = [(bits[a] - 2.0 * offset.get(a, 0)) * (bits[a] - 2.0 * offset.get(a, 0)) for a in grid.axes]
        return F.pow(reduce(lambda p, q: p + q, squares), F.lit(-power / 2))

    terms = [(F.col("coarse"), weight({}))] + [(F.col(n), weight(o)) for n, o in offsets.items()]
    over = reduce(lambda p, q: p + q, [F.coalesce(v.cast("double") * w, F.lit(0.0)) for v, w in terms])
    under = reduce(lambda p, q: p + q, [F.when(v.isNotNull(), w).otherwise(F.lit(0.0)) for v, w in terms])
    same = reduce(lambda p, q: p & q, [b == 0 for b in bits.values()])
    prediction = F.when(same, F.col("coarse").cast("double")).otherwise(over / under)
    return rows.select("var", *COORDS, "value", prediction.cast(grid.meta.elem.spark).alias("prediction"))


def linear_reconstruction(grid: Grid) -> DataFrame:
    """Per family the predictor whose values, reconstructed with the faces outside of the family, leave most leading zeros.

    A cell is reconstructed as (sum of outside faces + k * predictor) / (k + m) with its k faces within and m outside of
    the family. Returns ``var, t, z, y, x`` (the family's) ``, place`` (members in order, then mid-range and mean), ``predictor, zeros``.
    """
    grid = grid.along_curve
    kind, width = grid.meta.elem, grid.meta.elem.width
    starts = grid.meta.domain.starts(grid.meta.layout)
    offsets = face_offsets(grid)
    rows = stencil(grid, offsets)
    total, outside, inside = F.lit(0.0), F.lit(0), F.lit(0)
    for k, a in enumerate(reversed(grid.axes)):
        odd = (F.col(a) - starts[grid.axes.index(a)]) % 2 == 1
        for side in (0, 1):
            v = F.col(f"f{2 * k + side}")
            kin = odd if side == 0 else ~odd
            there = v.isNotNull()
            total = total + F.when(there & ~kin, v.cast("double")).otherwise(F.lit(0.0))
            outside = outside + F.when(there & ~kin, 1).otherwise(0)
            inside = inside + F.when(there & kin, 1).otherwise(0)
    rows = rows.select("var", *[c.alias(a) for a, c in _parents(grid).items()], morton_of(grid.axes, starts).alias("m"), "value", total.alias("s"), outside.alias("out"), inside.alias("kin"))
    members = F.array_sort(F.collect_list(F.struct("m", "value", "s", "out", "kin")))  # 16 at most
    families = rows.groupBy("var", *COORDS).agg(members.alias("fam"))
    values = F.transform("fam", lambda x: x["value"])
    families = families.withColumn("cand", F.concat(values, F.array(array_mid_range(values, kind), array_mean(values, kind))))
    tried = families.select("var", *COORDS, F.posexplode("cand").alias("place", "predictor"), "fam").select("var", *COORDS, "place", "predictor", F.explode("fam").alias("f"))
    p = F.col("predictor").cast("double")
    rebuilt = F.when(F.col("f.out") == 0, F.col("predictor")).otherwise(((F.col("f.s") + p * F.col("f.kin")) / (F.col("f.kin") + F.col("f.out"))).cast(kind.spark))
    tried = tried.withColumns({"a": to_bits(rebuilt, kind), "b": to_bits(F.col("f.value"), kind)})
    scored = tried.groupBy("var", *COORDS, "place").agg(F.first("predictor").alias("predictor"), F.sum(leading_zeros(abs_difference(F.col("a"), F.col("b"), width), width)).alias("zeros"))
    best = F.max_by(F.struct("place", "predictor", "zeros"), F.struct(F.col("zeros"), -F.col("place")))
    return scored.groupBy("var", *COORDS).agg(best.alias("r")).select("var", *COORDS, "r.place", "r.predictor", "r.zeros")


# --- order along the Morton curve ----------------------------------------------------------------------------------

def dense_index(df: DataFrame, key: str, by: tuple[str, ...] = ("var",), bucket_bits: int = 16, into: str = "i") -> DataFrame:
    """Adds the place of each row in order of a key (a non-negative bigint), from 0 within ``by``.

    Buckets of the key's range are counted and their counts summed up, which is all that meets in one task; rows are
    numbered within their bucket.
    """
    rows = df.withColumn("_bucket", shr(F.col(key), bucket_bits))
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), long(0))).drop("_n")
    within = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(key)) - 1
    return rows.withColumn("_within", within).join(counts, [*by, "_bucket"]).withColumn(into, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def extremes(grid: Grid) -> DataFrame:
    """Per family in Morton order ``var, m, i`` and its largest and smallest value with their cells' centres; no smallest one where all are equal."""
    grid = grid.along_curve
    starts = dict(zip(grid.axes, grid.meta.domain.starts(grid.meta.layout), strict=True))
    centre = [(F.col(a) - starts[a] + F.lit(0.5)).alias(a) for a in grid.axes]
    rows = grid.df.select("var", morton_of(grid.axes, grid.meta.domain.starts(grid.meta.layout)).alias("c"), "value", F.struct(*centre).alias("at"))
    rows = rows.groupBy("var", shr(F.col("c"), len(grid.axes)).alias("m"))
    out = rows.agg(F.max_by(F.struct("value", "at"), F.struct("value", -F.col("c"))).alias("high"), F.min_by(F.struct("value", "at"), F.struct("value", F.col("c"))).alias("low"))
    out = out.withColumn("low", F.when(F.col("low.value") != F.col("high.value"), F.col("low")))
    return dense_index(out, "m")


def _with_halos(families: DataFrame, length: int, bucket: int) -> DataFrame:
    """Families in each bucket ``b`` of places whose lines they are in."""
    place = F.col("i")
    # a family is in the lines of those from length - 1 before to half after it
    homes = F.array(*[F.call_function("div", F.greatest(p, long(0)), long(bucket)) for p in (place, place - (length - 1), place + (length - 1) // 2)])
    return families.withColumn("b", F.explode(F.array_distinct(homes)))


def scanline(coarse: DataFrame, length: int = 53, bucket: int = 4096) -> DataFrame:
    """Adds ``line``: the ``length`` consecutive families around each one, in Morton order; at the start and end those there are.

    Families are dealt by ranges of their place with halos, so no order over all rows is needed.
    """
    half, bucket = (length - 1) // 2, max(bucket, length)
    rows = _with_halos(coarse, length, bucket)
    w = W.partitionBy("var", "b").orderBy("i").rowsBetween(-half, length - 1)
    rows = rows.withColumn("line", F.collect_list(F.struct("i", "high", "low")).over(w))
    rows = rows.filter(F.call_function("div", F.col("i"), long(bucket)) == F.col("b"))
    first = F.greatest(F.col("i") - half, long(0))
    return rows.withColumn("line", F.filter("line", lambda x: (x["i"] >= first) & (x["i"] < first + length))).drop("b")


def scanline_prediction(grid: Grid, length: int = 53, nearest: int = 6, power: int = 16, bucket: int = 8192) -> DataFrame:
    """Inverse-distance weighting over the points of a family's scanline that are nearer than the one after the ``nearest``.

    Returns ``var, t, z, y, x, value, prediction``; a cell that is itself a point is predicted by its value. Families move
    with their cells, dealt by ranges of their place with halos; lines are windows over a range's points and never stored.
    """
    grid = grid.along_curve
    kind, axes, bucket, half = grid.meta.elem, grid.axes, max(bucket, length), (length - 1) // 2
    starts = dict(zip(axes, grid.meta.domain.starts(grid.meta.layout), strict=True))
    cells = grid.df.select("var", morton_of(axes, [*starts.values()]).alias("c"), *COORDS, "value")
    points = extremes(grid).select("var", "m", "i", *[F.col(f"{p}.value").cast("double").alias(f"{p}_v") for p in ("high", "low")], *[F.col(f"{p}.at.{a}").alias(f"{p}_{a}") for p in ("high", "low") for a in axes])
    points = written(points, f"{shared_folder(grid.df.sparkSession)}/points")
    homes = _with_halos(points.toDF(*points.columns), length, bucket)  # columns of its own, as both sides meet again
    own = cells.withColumn("m", shr(F.col("c"), len(axes))).join(points.select("var", "m", "i"), ["var", "m"])
    own = own.select("var", F.call_function("div", F.col("i"), long(bucket)).alias("b"), "i", *COORDS, "value")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("i")
        number = lambda rows, c: rows.column(c).to_numpy().astype(np.float64)
        both = lambda c: np.stack([number(right, f"{p}_{c}") for p in ("high", "low")], axis=1)
        at, value = {a: both(a) for a in axes}, both("v")
        first, n = right.column("i")[0].as_py() if len(right) else 0, len(right)  # places in a bucket and its halo are consecutive
        places, own_at = left.column("i").to_numpy(), {a: number(left, a) - starts[a] + 0.5 for a in axes}
        out, lacks = np.zeros(len(left)), np.zeros(len(left), bool)
        for start in range(0, len(left), 4096):
            part = slice(start, start + 4096)
            line = (np.maximum(places[part] - half, 0) - first)[:, None] + np.arange(length)
            there = line < n
            line = np.where(there, line, 0)
            d = sum((at[a][line] - own_at[a][part, None, None]) ** 2 for a in axes)
            d = np.where(there[:, :, None] & ~np.isnan(d), d, np.inf).reshape(len(line), -1)  # infinitely far where there is no point
            v = value[line].reshape(len(line), -1)
            radius = np.partition(d, nearest, axis=1)[:, nearest] if nearest < d.shape[1] else np.full(len(line), np.inf)
            row, column = np.nonzero(d < radius[:, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                w = d[row, column] ** (-power / 2)
                under = np.bincount(row, w, len(line))
                p = np.bincount(row, w * v[row, column], len(line)) / under
            hit = d == 0
            found = hit.any(axis=1)
            p[found] = v[found, hit[found].argmax(axis=1)]
            out[part], lacks[part] = p, ~found & ~(under > 0)
        return left.select(["var", *COORDS, "value"]).append_column("prediction", pa.array(out, mask=lacks, from_pandas=False))

    found = own.groupBy("var", "b").cogroup(homes.groupBy("var", "b")).applyInArrow(run, f"var string, t long, z long, y long, x long, value {kind.spark}, prediction double")
    return found.select("var", *COORDS, "value", F.col("prediction").cast(kind.spark).alias("prediction"))
