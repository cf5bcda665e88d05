"""Headerless binary arrays: one native-endian value after the other in a layout's order.

A file is read as one row of bytes by the task that turns it into cells, so many files are read in parallel; a file of
more than 2 GB must be split. Values are positions in the domain, or follow the file's part of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.coords import delinearize, linearize
from gridloom.operators.grid import Grid, slice_grid
from gridloom.plans.domain import COORDS, Domain, GridMeta, Layout
from gridloom.plans.storage import open_output
from gridloom.plans.types import Elem, elem

_BATCH = 1 << 20


def _arrow(kind: Elem, values: np.ndarray) -> pa.Array:
    if kind.name == "uint64":
        import decimal

        return pa.array([decimal.Decimal(v) for v in values.tolist()], pa.decimal128(20, 0))
    target = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[kind.spark]
    return pa.array(values).cast(target)


def read_values(spark: SparkSession, path: str, kind: str | Elem) -> DataFrame:
    """``path, i, value``: the values of each file by their place in it."""
    kind = elem(kind)
    size = kind.width // 8

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                buffer = data.as_buffer()
                if buffer.size % size:
                    raise ValueError(f"{name} has {buffer.size} bytes, no multiple of {size}")
                values = np.frombuffer(buffer, kind.numpy)
                for at in range(0, len(values), _BATCH):
                    part = values[at : at + _BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array(np.arange(at, at + len(part))), _arrow(kind, part)], names=["path", "i", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"path string, i long, value {kind.spark}")


def read_binary(spark: SparkSession, path: str, kind: str | Elem, name: str, layout: str | Layout, domain: Domain, missing: float | int | None = None, sub_domain: Domain | None = None, check: bool = True) -> Grid:
    """A variable from one file that holds its whole domain; of ``sub_domain`` only those cells, padded with the missing value.

    ``check`` compares the file's size with the domain's before any value is read.
    """
    kind, layout = elem(kind), Layout.parse(layout)
    if check:
        found = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        if found != domain.size * kind.width // 8:
            raise ValueError(f"{path} has {found} bytes; the domain takes {domain.size * kind.width // 8}")
    coords = delinearize(layout, domain, F.col("i"))
    cells = read_values(spark, path, kind).select(F.lit(name).alias("var"), *[coords[a].alias(a) for a in COORDS], "value")
    grid = Grid(cells, GridMeta(name, kind, layout, domain, missing))
    return grid if sub_domain is None else slice_grid(grid, sub_domain)


def write_binary(grid: Grid, path: str) -> None:
    """One file in the layout's order; the driver passes on one sorted partition after the other."""
    kind = grid.meta.elem
    rows = grid.df.withColumn("i", linearize(grid.meta.layout, grid.meta.domain)).filter(F.col("i").isNotNull())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = batch.column(0)
            values = np.array([int(v) for v in column.to_pylist()], np.uint64) if kind.name == "uint64" else np.asarray(column)
            yield pa.RecordBatch.from_arrays([pa.array([values.astype(kind.numpy).tobytes()], pa.binary())], names=["data"])

    parts = rows.repartitionByRange("i").sortWithinPartitions("i").select("value").mapInArrow(run, "data binary")
    out = open_output(grid.df.sparkSession, path)
    try:
        for row in parts.toLocalIterator():
            out.write(row["data"])
    finally:
        out.close()
