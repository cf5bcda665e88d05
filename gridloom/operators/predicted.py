"""Lossless coding of each level against what is predicted from the level above: by faces or by inverse distances.

On the way up a level's cells are predicted from the coarser cells that a decoder will have, and the difference of the bit
patterns is kept. On the way down the same expressions over the same coarse values give the same predictions, so
the differences restore every cell bit by bit. Each coarse level is written, so the work of a level is done once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.bits import abs_difference, from_bits, leading_zeros, to_bits, wrap_add, wrap_sub
from gridloom.functions.families import mean
from gridloom.operators.grid import Grid
from gridloom.operators.neighbours import HEX_WEIGHTS, first_children, idw_prediction, predicted_by_faces
from gridloom.operators.pyramid import coarsen
from gridloom.plans.domain import COORDS, GridMeta
from gridloom.plans.storage import shared_folder, written

#: Ways to predict: the mean of the coarse value and the near faces, weights for near and far faces, inverse distances.
METHODS = ("near", "weighted", "distance")


@dataclass(frozen=True)
class Predicted:
    """Differences of all levels (``var, level, t, z, y, x, diff, nbits``), the description of each level, and the topmost grid."""

    method: str
    meta: GridMeta
    metas: tuple[GridMeta, ...]
    differences: DataFrame
    top: Grid


def _above(grid: Grid, method: str) -> Grid:
    return first_children(grid) if method == "distance" else coarsen(grid, mean(grid.meta.elem))


def _prediction(cells: Grid, coarse: Grid, method: str) -> DataFrame:
    """The cells' ``var, t, z, y, x, value`` with their ``prediction``."""
    if method == "distance":
        return idw_prediction(cells, coarse)
    return predicted_by_faces(cells, coarse, HEX_WEIGHTS if method == "weighted" else None)


def compress_predicted(grid: Grid, method: str = "near", folder: str | None = None) -> Predicted:
    """Differences of every level down from the top, which has one cell.

    A family's value is its mean, or for ``distance`` its first child. Weights are meant for three dimensions, where they add up to 1.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    kind, folder = grid.meta.elem, folder or shared_folder(grid.df.sparkSession)
    now, metas = grid.along_curve, []
    for level in range(grid.meta.depth):
        above = _above(now, method)
        above = Grid(written(above.df, f"{folder}/values-{level + 1}"), above.meta)
        rows = _prediction(now, above, method)
        a, b = to_bits(F.col("value"), kind), to_bits(F.col("prediction"), kind)
        nbits = F.lit(kind.width) - leading_zeros(abs_difference(a, b, kind.width), kind.width)
        rows.select("var", *COORDS, wrap_sub(a, b, kind.width).alias("diff"), nbits.cast("int").alias("nbits")).write.mode("overwrite").parquet(f"{folder}/differences/level={level}")
        metas.append(now.meta)
        now = above
    schema = "var string, t long, z long, y long, x long, diff long, nbits int, level int"
    spark = grid.df.sparkSession
    differences = spark.read.schema(schema).parquet(f"{folder}/differences") if metas else spark.createDataFrame([], schema)
    return Predicted(method, grid.meta, tuple(metas), differences, now)


def decompress_predicted(made: Predicted, folder: str | None = None) -> Grid:
    """The grid again, bit by bit."""
    kind, now = made.meta.elem, made.top
    folder = folder or shared_folder(made.differences.sparkSession)
    for level in range(len(made.metas) - 1, -1, -1):
        cells = made.differences.filter(F.col("level") == level).select("var", *COORDS, F.col("diff").alias("value"))
        rows = _prediction(Grid(cells, made.metas[level]), now, made.method)
        bits = wrap_add(to_bits(F.col("prediction"), kind), F.col("value"), kind.width)
        now = Grid(written(rows.select("var", *COORDS, from_bits(bits, kind).alias("value")), f"{folder}/restored-{level}"), made.metas[level])
    return Grid(now.df, made.meta)
