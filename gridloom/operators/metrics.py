"""Quality of restored grids and size models: global aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import Grid, linear
from gridloom.operators.pyramid import Pyramid


def paired(initial: Grid, restored: Grid) -> DataFrame:
    """``i, initial, restored`` by linear index; null where one side has no such cell."""
    a = linear(initial).select("i", F.col("value").alias("initial"))
    b = linear(restored).select("i", F.col("value").alias("restored"))
    return a.join(b, "i", "full")


def errors(pairs: DataFrame) -> DataFrame:
    """Adds ``abs_err`` and ``rel_err``; the latter is 0 where the initial value is 0."""
    v = F.col("initial").cast("double")
    d = F.abs(v - F.col("restored").cast("double"))
    return pairs.withColumns({"abs_err": d, "rel_err": F.when(v == 0, F.lit(0.0)).otherwise(d / F.nullif(F.abs(v), F.lit(0.0)))})


def quality(pairs: DataFrame, abs_bound: float | None = None, rel_bound: float | None = None) -> DataFrame:
    """One row: largest errors and where the relative one is, violations of the bounds, MSE, RMSE and PSNR."""
    e = errors(pairs)
    count = lambda column, bound: F.count_if(F.col(column) > bound) if bound is not None else F.lit(0).cast("long")
    out = e.agg(
        F.count("*").alias("n"),
        F.max("abs_err").alias("max_abs_err"),
        F.max("rel_err").alias("max_rel_err"),
        F.max_by("i", F.struct("rel_err", -F.col("i"))).alias("max_rel_at"),
        count("abs_err", abs_bound).alias("abs_violations"),
        count("rel_err", rel_bound).alias("rel_violations"),
        F.avg(F.col("abs_err") * F.col("abs_err")).alias("mse"),
        (F.max("initial").cast("double") - F.min("initial").cast("double")).alias("spread"),
    )
    peak = F.when((F.col("mse") > 0) & (F.col("spread") > 0), 20 * F.log10(F.abs("spread")) - 10 * F.log10("mse"))
    return out.withColumns({"rmse": F.sqrt("mse"), "psnr": peak}).drop("spread")


def equality(pairs: DataFrame) -> DataFrame:
    """One row: whether both sides have the same cells and values, how many differ, and the first index that does."""
    differs = ~F.col("initial").eqNullSafe(F.col("restored"))
    return pairs.agg(F.coalesce(F.bool_and(~differs), F.lit(True)).alias("equal"), F.count_if(differs).alias("mismatches"), F.min(F.when(differs, F.col("i"))).alias("first_mismatch"))


def level_sizes(pyramid: Pyramid) -> DataFrame:
    """``var, level, n, payload_bits, payload_bytes`` of each level."""
    sizes = pyramid.residuals.groupBy("var", "level").agg(F.count("*").alias("n"), F.sum("nbits").alias("payload_bits"))
    return sizes.withColumn("payload_bytes", F.ceil(F.col("payload_bits") / 8))


def compression_ratio(pyramid: Pyramid, entropy_bits: DataFrame) -> DataFrame:
    """``var, raw_bytes, modelled_bytes, ratio``: cells against payloads, entropy-coded symbols and tables."""
    from gridloom.functions.symbols import alphabet_size

    width = pyramid.meta.elem.width
    table = 4 * (1 + alphabet_size(pyramid.scheme, width)) + 32
    per_level = level_sizes(pyramid).join(entropy_bits, ["var", "level"], "left")
    bytes_ = F.col("payload_bytes") + F.ceil(F.coalesce("entropy_bits", F.lit(0.0)) / 8) + table
    out = per_level.groupBy("var").agg(F.max(F.when(F.col("level") == 0, F.col("n") * (width // 8))).alias("raw_bytes"), F.sum(bytes_).alias("modelled_bytes"))
    return out.withColumn("ratio", F.col("raw_bytes") / F.col("modelled_bytes"))
