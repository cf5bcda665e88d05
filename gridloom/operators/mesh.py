"""Tree meshes: domains embedded in the smallest tree that holds them, caller's forests, and the mesh's own code.

An element is ``var, m, level``: the Morton index of its corner cell and the number of halvings that it lacks (0: a cell).
Elements outside of the domain exist only where a neighbour had to be refined; they hold the missing value.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.bits import from_bits, long, shl, shr, to_bits
from gridloom.functions.coords import in_domain, morton_encode
from gridloom.operators.grid import Grid
from gridloom.operators.neighbours import dense_index
from gridloom.operators.pyramid import SCHEMES, Pyramid, cells_of, compress_cells, decompress_cells, grid_from_cells
from gridloom.plans.domain import DIMENSIONS, Domain, GridMeta, Layout
from gridloom.plans.storage import shared_folder, written
from gridloom.plans.types import Elem


def padding(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """``m, level`` of all elements outside of the domain, generated in parallel: per level the children beyond an odd edge."""
    lengths, dim = [*reversed(meta.domain.lengths(meta.layout.curve))], meta.dimensionality  # x first
    parts = []
    for level in range(meta.depth):
        inside = [-(-n // (1 << level)) for n in lengths]
        whole = [2 * -(-n // (1 << (level + 1))) for n in lengths]
        for k in range(dim):
            if inside[k] == whole[k]:
                continue
            # beyond the edge along axis k, inside along the axes before it
            spans = [inside[j] if j < k else 1 if j == k else whole[j] for j in range(dim)]
            rest, coords = F.col("id"), []
            for j, n in enumerate(spans):
                coords.append(rest % n if j != k else long(inside[k]))
                rest = F.call_function("div", rest, long(n))
            cells = spark.range(int(np.prod(spans))).select(*[c.alias(f"c{j}") for j, c in enumerate(coords)])
            parts.append(cells.select(shl(morton_encode(*[F.col(f"c{j}") for j in range(dim)]), dim * level).alias("m"), F.lit(level).alias("level")))
    empty = spark.range(0).select(F.col("id").alias("m"), F.lit(0).alias("level"))
    return reduce(lambda a, b: a.unionByName(b), parts, empty)


def embedded_elements(grid: Grid) -> DataFrame:
    """``var, m, level, bits, v`` of the embedded mesh: the domain's cells and the padding."""
    kind = grid.meta.elem
    missing = F.lit(grid.meta.missing).cast(kind.spark)
    outside = padding(grid.df.sparkSession, grid.meta).select(F.lit(grid.meta.name).alias("var"), "m", "level", missing.alias("v"))
    outside = outside.select("var", "m", "level", to_bits(F.col("v"), kind).alias("bits"), "v")
    return cells_of(grid.along_curve).select("var", "m", F.lit(0).alias("level"), "bits", "v").unionByName(outside)


def compress_embedded(grid: Grid, scheme: str = "prefix") -> Pyramid:
    """Lossless compression on the embedded tree. Padding passes the levels below its own unchanged."""
    cells = embedded_elements(grid).select("var", "m", "bits", "v")
    return compress_cells(cells, grid.meta.dimensionality, grid.meta.depth, SCHEMES[scheme](grid.meta.elem), grid.meta)


def decompress_embedded(pyramid: Pyramid) -> Grid:
    """The domain's cells again, without the padding."""
    cells = decompress_cells(pyramid, pyramid.meta.dimensionality, SCHEMES[pyramid.scheme](pyramid.meta.elem))
    meta = pyramid.meta.but(layout=pyramid.meta.layout.curve)
    grid = grid_from_cells(cells.select("var", "m", "bits"), meta)
    return Grid(grid.df.filter(in_domain(pyramid.meta.layout, pyramid.meta.domain)), pyramid.meta)


def compress_forest(elements: DataFrame, dim: int, depth: int, kind: Elem, scheme: str = "prefix") -> Pyramid:
    """Lossless compression of a caller's forest: ``var, tree, m, level, value``, with trees of up to ``depth`` halvings.

    The elements of each tree must cover it. Every tree has a pyramid of its own.
    """
    rows = elements.select(F.concat_ws("/", "var", F.col("tree").cast("string")).alias("var"), "m", to_bits(F.col("value"), kind).alias("bits"), F.col("value").alias("v"))
    layout = Layout.default(dim)
    meta = GridMeta("forest", kind, layout, Domain.default(layout, [1 << depth] * dim))
    return compress_cells(rows, dim, depth, SCHEMES[scheme](kind), meta)


def decompress_forest(pyramid: Pyramid) -> DataFrame:
    """``var, tree, m, value`` of the forest's elements."""
    kind = pyramid.meta.elem
    cells = decompress_cells(pyramid, pyramid.meta.dimensionality, SCHEMES[pyramid.scheme](kind))
    parts = F.split("var", "/")
    return cells.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("var"), F.element_at(parts, -1).cast("long").alias("tree"), "m", from_bits(F.col("bits"), kind).alias("value"))


# --- the mesh's code -----------------------------------------------------------------------------------------------

def refinement_bits(elements: DataFrame, dim: int, depth: int) -> DataFrame:
    """``var, step, m, refined``: for each step, coarsest first, one bit per element of the coarser mesh in order of ``m``.

    A bit is set where the element is refined into its family.
    """
    now, parts, folder = elements.select("var", "m", "level"), [], shared_folder(elements.sparkSession)
    for step in range(depth):
        low = (1 << (dim * (step + 1))) - 1
        refined = F.col("level") <= step
        corner = F.when(refined, F.col("m").bitwiseAND(F.bitwise_not(long(low)))).otherwise(F.col("m"))
        level = F.when(refined, F.lit(step + 1)).otherwise(F.col("level"))
        # each step's mesh is written, as the next one and its own bits both read it
        now = written(now.select("var", corner.alias("m"), level.alias("level"), refined.alias("refined")).distinct(), f"{folder}/mesh-{step}")
        parts.append(now.select("var", F.lit(depth - 1 - step).alias("step"), "m", "refined"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def pack_bits(bits: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``var, step, chunk, n, data``: bits in order, eight to a byte, the first lowest. ``chunk`` is a multiple of 8."""
    rows = dense_index(bits, "m", ("var", "step")).withColumn("chunk", F.call_function("div", F.col("i"), long(chunk)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        data = np.packbits(pdf["refined"].to_numpy(bool), bitorder="little").tobytes()
        return pd.DataFrame({"var": [key[0]], "step": [key[1]], "chunk": [key[2]], "n": [len(pdf)], "data": [data]})

    return rows.groupBy("var", "step", "chunk").applyInPandas(run, "var string, step int, chunk long, n long, data binary")


def unpack_bits(packed: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``var, step, i, refined``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                bits = np.unpackbits(np.frombuffer(r.data, np.uint8), bitorder="little", count=r.n).astype(bool)
                yield pd.DataFrame({"var": r.var, "step": r.step, "i": r.chunk * chunk + np.arange(r.n), "refined": bits})

    return packed.mapInPandas(run, "var string, step int, i long, refined boolean")


def decode_mesh(bits: DataFrame, dim: int, depth: int) -> DataFrame:
    """``var, m, level`` of the elements that a mesh's bits (``var, step, i, refined``) describe, from one root per variable."""
    folder = shared_folder(bits.sparkSession)
    # written, as each step reads its own bits and would unpack those of all steps, and make them, for it
    bits = written(bits.select("var", "step", "i", "refined"), f"{folder}/bits", ("step",))
    now = bits.select("var").distinct().select("var", long(0).alias("m"), F.lit(depth).alias("level"))
    for step in range(depth):
        level = depth - 1 - step
        here = bits.filter(F.col("step") == step).select("var", "i", "refined")
        children = F.when(F.col("refined"), F.sequence(long(0), long((1 << dim) - 1))).otherwise(F.array(long(0)))
        rows = dense_index(now, "m").join(here, ["var", "i"])
        rows = rows.select("var", "m", F.when(F.col("refined"), F.lit(level)).otherwise(F.col("level")).alias("level"), F.explode(children).alias("c"))
        now = written(rows.select("var", (F.col("m") + shl(F.col("c"), dim * level)).alias("m"), "level"), f"{folder}/mesh-{step}")
    return now


_ROOT = struct.Struct(">3I8Q")


def root_record(meta: GridMeta) -> bytes:
    """Size of the record, dimensionality, tree depth, then all starts and all ends in order of the dimensions."""
    bounds = [meta.domain.interval(d) for d in DIMENSIONS]
    return _ROOT.pack(_ROOT.size, meta.domain.dimensionality, meta.depth, *[s for s, _ in bounds], *[e for _, e in bounds])


def read_root_record(data: bytes) -> tuple[int, int, Domain]:
    """(dimensionality, depth, domain)."""
    _, dim, depth, *bounds = _ROOT.unpack_from(data)
    return dim, depth, Domain({d: (bounds[k], bounds[k + 4]) for k, d in enumerate(DIMENSIONS)})


def owning_part(m: Column, offsets: list[int]) -> Column:
    """The part of a mesh, dealt out by the first Morton index of each part, that holds an element."""
    return F.size(F.filter(F.array(*[long(o) for o in offsets]), lambda o: o <= m)) - 1


def repartition_by_curve(df: DataFrame, parts: int, key: str = "m") -> DataFrame:
    """Contiguous ranges of the Morton curve, one per partition, in order."""
    return df.repartitionByRange(parts, key).sortWithinPartitions(key)


def ancestors_of(elements: DataFrame, dim: int, level: int) -> DataFrame:
    """Adds ``up``, the index of the node at a level that holds each element."""
    return elements.withColumn("up", shr(F.col("m"), dim * level))
