"""Bit functions on raw patterns, as column expressions.

A pattern is a bigint. Types of up to 32 bits leave its upper bits zero; 64-bit patterns use all of it, so they may be
negative, and nothing here overflows under ANSI rules. Bit positions count from the lowest; ``front`` and ``tail`` are
the numbers of bits that do not belong to a value at its upper and lower end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.plans.types import Elem

_LARGEST = (1 << 63) - 1


def long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def mask(width: int) -> Column:
    """All bits of a type set."""
    return long(-1 if width == 64 else (1 << width) - 1)


def shl(x: Column, n: Column | int) -> Column:
    """``x << n`` within 64 bits, n below 64."""
    return F.call_function("shiftleft", x, (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def shr(x: Column, n: Column | int) -> Column:
    """``x >> n`` with zeros moving in, n below 64."""
    return F.call_function("shiftrightunsigned", x, (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def minus_one(x: Column) -> Column:
    """``x - 1`` modulo 2**64."""
    return F.coalesce(F.try_subtract(x, long(1)), long(_LARGEST))


def wrap_add(a: Column, b: Column, width: int) -> Column:
    """The sum modulo 2**width."""
    if width < 64:
        return (a + b).bitwiseAND(mask(width))
    half = long((1 << 32) - 1)
    low = a.bitwiseAND(half) + b.bitwiseAND(half)
    return shl(shr(a, 32) + shr(b, 32) + shr(low, 32), 32).bitwiseOR(low.bitwiseAND(half))


def wrap_sub(a: Column, b: Column, width: int) -> Column:
    """The difference modulo 2**width."""
    if width < 64:
        return (a - b).bitwiseAND(mask(width))
    return wrap_add(wrap_add(a, F.bitwise_not(b), 64), long(1), 64)


def unsigned_ge(a: Column, b: Column, width: int) -> Column:
    if width < 64:
        return a >= b
    flip = long(-_LARGEST - 1)
    return a.bitwiseXOR(flip) >= b.bitwiseXOR(flip)


def abs_difference(a: Column, b: Column, width: int) -> Column:
    """The larger less the smaller pattern, both unsigned."""
    if width < 64:
        return F.abs(a - b)
    return F.when(unsigned_ge(a, b, 64), wrap_sub(a, b, 64)).otherwise(wrap_sub(b, a, 64))


def leading_zeros(x: Column, width: int) -> Column:
    """``width`` for 0. The pattern stands in it once, as it may be a large expression."""
    return F.lit(width) - F.length(F.ltrim(F.bin(x), F.lit("0")))


def trailing_zeros(x: Column, width: int) -> Column:
    """``width`` for 0."""
    return F.least(F.bit_count(F.bitwise_not(x).bitwiseAND(minus_one(x))), F.lit(width))


def trailing_ones(x: Column, width: int) -> Column:
    return trailing_zeros(F.bitwise_not(x).bitwiseAND(mask(width)), width)


def significant_bits(front: Column, tail: Column, width: int) -> Column:
    return F.lit(width) - front - tail


def payload(x: Column, front: Column, count: Column, width: int) -> Column:
    """The ``count`` bits below the ``front`` highest, as a number."""
    drop = F.lit(width) - front - count
    kept = F.when(drop >= 64, long(0)).otherwise(shr(x, drop))
    ones = F.when(count >= 64, long(-1)).otherwise(minus_one(shl(long(1), count)))
    return kept.bitwiseAND(ones)


def left_aligned(x: Column, front: Column, count: Column, width: int) -> Column:
    """Those bits moved to the upper end of the pattern."""
    room = F.lit(width) - count
    return F.when(room >= 64, long(0)).otherwise(shl(payload(x, front, count, width), room)).bitwiseAND(mask(width))


def keep_front(x: Column, count: Column, width: int) -> Column:
    """The ``count`` highest bits, the others cleared."""
    rest = F.when(count >= width, long(0)).otherwise(shr(mask(width), count))
    return x.bitwiseAND(F.bitwise_not(rest)).bitwiseAND(mask(width))


def nullify_front(x: Column, front: Column, width: int) -> Column:
    rest = F.when(front >= width, long(0)).otherwise(shr(mask(width), front))
    return x.bitwiseAND(rest)


def zeros_in_significant(x: Column, front: Column, tail: Column, width: int) -> Column:
    """Leading zeros within the significant part."""
    count = significant_bits(front, tail, width)
    return F.least(leading_zeros(left_aligned(x, front, count, width), width), count)


def common_prefix(a: Column, b: Column, len_a: Column | int, len_b: Column | int, width: int) -> Column:
    """Length of the prefix that two values share."""
    as_col = lambda n: n if isinstance(n, Column) else F.lit(n)
    return F.least(as_col(len_a), as_col(len_b), leading_zeros(a.bitwiseXOR(b), width))


def family_prefix(any_set: Column, all_set: Column, least: Column, width: int) -> Column:
    """Length of the prefix that all members share, from their OR, their AND and their least length."""
    return F.least(least, leading_zeros(any_set.bitwiseXOR(all_set), width))


def clear_lowest(x: Column) -> Column:
    """Without the lowest set bit."""
    return x.bitwiseAND(minus_one(x))


def toggle_tail(x: Column, width: int) -> Column:
    """Clears the lowest run of ones and sets the zero above it."""
    return wrap_add(x, x.bitwiseAND(F.bitwise_not(minus_one(x))), width)


def toggle_bit(x: Column, k: Column | int, width: int) -> Column:
    return x.bitwiseXOR(shl(long(1), k)).bitwiseAND(mask(width))


def toggle_and_reset(x: Column, k: Column | int, width: int) -> Column:
    """Toggles bit k; bits below become 0 if it was set and 1 if it was not."""
    low = minus_one(shl(long(1), k))
    was = shr(x, k).bitwiseAND(long(1)) == 1
    return F.when(was, toggle_bit(x, k, width).bitwiseAND(F.bitwise_not(low))).otherwise(toggle_bit(x, k, width).bitwiseOR(low)).bitwiseAND(mask(width))


def apply_suffix(x: Column, tail: Column, suffix: Column, count: Column) -> Column:
    """Sets ``count`` bits right below the significant part, whose ``tail`` shrinks by as many."""
    return F.when(count == 0, x).otherwise(x.bitwiseOR(shl(suffix, tail - count)))


def equal_tail(x: Column, width: int) -> Column:
    """Length of the run of equal bits at the lower end."""
    return F.greatest(trailing_zeros(x, width), trailing_ones(x, width))


def drop_equal_tail(x: Column, tail: Column, width: int) -> Column:
    """Without that run; of a pattern that is one run the highest bit stays, as nothing else says which bits were dropped."""
    return keep_front(x, F.greatest(F.lit(width) - tail, F.lit(1)), width)


def restore_equal_tail(x: Column, tail: Column, width: int) -> Column:
    """The dropped run again: the complement of the lowest bit that was kept; where all is one run, its highest bit."""
    low = F.when(tail >= 64, long(-1)).otherwise(minus_one(shl(long(1), tail))).bitwiseAND(mask(width))
    zeros = F.when(tail >= width, shr(x, width - 1).bitwiseAND(long(1)) == 0).otherwise(shr(x, tail).bitwiseAND(long(1)) == 1)
    clean = x.bitwiseAND(F.bitwise_not(low))
    return F.when(zeros, clean).otherwise(clean.bitwiseOR(low))


def to_bits(x: Column, kind: Elem) -> Column:
    """The raw pattern of a value (JVM-side); null for null."""
    if kind.name == "float":
        bits = F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), F.coalesce(x.cast("float"), F.lit(0.0).cast("float")))
        return F.when(x.isNotNull(), bits.cast("long").bitwiseAND(mask(32)))
    if kind.name == "double":
        bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(x.cast("double"), F.lit(0.0)))
        return F.when(x.isNotNull(), bits.cast("long"))
    if kind.name == "uint64":
        big = F.lit(str(1 << 64)).cast("decimal(20,0)")
        return F.when(x > _LARGEST, x - big).otherwise(x).cast("long")
    return x.cast("long").bitwiseAND(mask(kind.width))


def from_bits(bits: Column, kind: Elem) -> Column:
    """The value of a raw pattern; null for null."""
    if kind.name == "float":
        signed = F.when(bits >= 1 << 31, bits - (1 << 32)).otherwise(F.coalesce(bits, long(0))).cast("int")
        return F.when(bits.isNotNull(), F.reflect(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), signed).cast("float"))
    if kind.name == "double":
        return F.when(bits.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), F.coalesce(bits, long(0))).cast("double"))
    if kind.name == "uint64":
        wide = bits.cast("decimal(20,0)")
        return F.when(bits < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
    if kind.is_signed and kind.width < 64:
        bits = F.when(bits >= 1 << (kind.width - 1), bits - (1 << kind.width)).otherwise(bits)
    return bits.cast(kind.spark)
