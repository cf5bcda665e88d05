"""Symbols of the entropy coders and their places in the alphabets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark of a residual that is added, the end of a chunk.
SIGN = 1 << 30
BOUNDARY = 1 << 31
#: What scaled frequencies add up to, about.
TARGET = 16350
#: Fixed values of residual quantization: the first bin that isn't coded, which is also the offset of negative bins, and the alphabet's size.
OUTLIER, QUANTIZED_SYMBOLS = 2045, 32768


def alphabet_size(scheme: str, width: int) -> int:
    """Symbols 0 to width and the boundary; twice as many for residuals with a sign; codes of four bits for XOR."""
    return {"prefix": width + 2, "multires": 2 * (width + 1) + 1, "trimmed": 2 * (width + 1) + 1, "xor": 17, "quantized": QUANTIZED_SYMBOLS}[scheme]


def signed_zeros(zeros: Column, added: Column, width: int) -> Column:
    """Leading zeros, marked where the residual is added; a residual of zero is never marked."""
    return (zeros + F.when(added & (zeros < width), F.lit(SIGN)).otherwise(F.lit(0))).cast("long")


def symbol_index(symbol: Column, scheme: str, width: int) -> Column:
    """Place of a symbol in its alphabet; the boundary is last."""
    last = alphabet_size(scheme, width) - 1
    plain = F.when(symbol >= SIGN, symbol - SIGN + (width + 1)).otherwise(symbol) if scheme in ("multires", "trimmed") else symbol
    return F.when(symbol == BOUNDARY, F.lit(last)).otherwise(plain).cast("int")


def index_symbol(index: Column, scheme: str, width: int) -> Column:
    """The symbol at a place of the alphabet."""
    last = alphabet_size(scheme, width) - 1
    plain = F.when(index > width, index - (width + 1) + SIGN).otherwise(index) if scheme in ("multires", "trimmed") else index
    return F.when(index == last, F.lit(BOUNDARY)).otherwise(plain).cast("long")


def quantized(residual: Column, bound: float, budget: Column | float) -> Column:
    """0 within the budget; else the bin floor(|r| / 2eps + 0.5), from OUTLIER on for negative residuals; OUTLIER alone for those beyond."""
    step = F.floor(F.abs(residual) / (2 * bound) + 0.5)
    inside = F.when(residual < 0, step + OUTLIER).otherwise(step)
    return F.when(F.abs(residual) <= budget, F.lit(0)).when(step < OUTLIER, inside).otherwise(F.lit(OUTLIER)).cast("int")


def residual_bin(residual: Column, step: Column | float, bins: int = 10) -> Column:
    """1 to ``bins`` by multiples of ``step``, and one more for what lies beyond."""
    n = F.greatest(F.ceil(F.abs(residual) / step), F.lit(1))
    return F.least(n, F.lit(bins + 1)).cast("int")
