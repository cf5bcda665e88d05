"""Grids that arrive over time: every batch of whole time slices is compressed on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.entropy import level_entropy, symbol_frequencies
from gridloom.operators.grid import COLUMNS, Grid
from gridloom.operators.metrics import level_sizes
from gridloom.operators.pyramid import compress
from gridloom.plans.domain import GridMeta


def slice_sizes(cells: DataFrame, meta: GridMeta, scheme: str = "prefix") -> DataFrame:
    """``var, t, level, n, payload_bits, payload_bytes, entropy_bits`` of time slices (``var, t, z, y, x, value``), each a grid of its own."""
    named = cells.select(F.concat_ws("@", "var", F.col("t").cast("string")).alias("var"), F.lit(0).cast("long").alias("t"), *COLUMNS[2:])
    pyramid = compress(Grid(named, meta), scheme)
    sizes = level_sizes(pyramid).join(level_entropy(symbol_frequencies(pyramid)).drop("symbols"), ["var", "level"], "left")
    parts = F.split("var", "@")
    return sizes.select(F.get(parts, F.lit(0)).alias("var"), F.get(parts, F.lit(1)).cast("long").alias("t"), "level", "n", "payload_bits", "payload_bytes", "entropy_bits")


def compress_stream(cells: DataFrame, meta: GridMeta, out: str, checkpoint: str, scheme: str = "prefix", **trigger) -> StreamingQuery:
    """Starts a query over a stream of cells that appends each batch's slice sizes to a Parquet table.

    ``meta`` describes one slice (no time in its layout). Each batch holds whole slices, as files per time step do; a batch
    that runs again overwrites its own part.
    """

    def each(batch: DataFrame, number: int) -> None:
        slice_sizes(batch, meta, scheme).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return cells.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
