"""Bit functions against plain integer arithmetic, and golden values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import bits as B
from gridloom.functions import packing as P
from gridloom.plans.types import ELEMS, elem

EDGES = [0, 1, 2, 3, 0x7FFFFFFF, 0x80000000, 0xFFFFFFFF, 1213, 0xF0F0F0F0]


def patterns(width, n=60):
    r = np.random.default_rng(width)
    top = (1 << width) - 1
    return [x & top for x in (*EDGES, top, 1 << (width - 1), *(int(v) for v in r.integers(0, 1 << 62, n)), *(int(v) << 1 | 1 for v in r.integers(0, 1 << 63, n, dtype=np.uint64)))]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def lz(x, w):
    return w - x.bit_length()


def tz(x, w):
    return w if x == 0 else (x & -x).bit_length() - 1


@pytest.mark.parametrize("width", [8, 32, 64])
def test_unary_functions(spark, width):
    xs = patterns(width)
    top = (1 << width) - 1
    x = F.col("x")
    cols = {
        "lz": B.leading_zeros(x, width),
        "tz": B.trailing_zeros(x, width),
        "ones": B.trailing_ones(x, width),
        "cleared": B.clear_lowest(x),
        "toggled": B.toggle_tail(x, width),
        "bit": B.toggle_bit(x, 3, width),
        "reset": B.toggle_and_reset(x, 4, width),
        "tail": B.equal_tail(x, width),
        "restored": B.restore_equal_tail(x, B.equal_tail(x, width), width),
        "front": B.keep_front(x, F.lit(5), width),
        "rest": B.nullify_front(x, F.lit(3), width),
        "body": B.payload(x, F.lit(2), F.lit(4), width),
        "left": B.left_aligned(x, F.lit(2), F.lit(4), width),
        "whole": B.payload(x, F.lit(0), F.lit(width), width),
    }
    rows = spark.createDataFrame([(signed(v),) for v in xs], "x long").select("x", *[c.alias(k) for k, c in cols.items()]).collect()
    for v, r in zip(xs, rows, strict=True):
        run = max(tz(v, width), tz(~v & top, width))
        want = {
            "lz": lz(v, width),
            "tz": tz(v, width),
            "ones": tz(~v & top, width),
            "cleared": v & (v - 1) if v else 0,
            "toggled": (v + (v & -v)) & top,
            "bit": v ^ 8,
            "reset": (v ^ 16) & ~15 & top if v >> 4 & 1 else (v ^ 16) | 15,
            "tail": run,
            "restored": v,
            "front": v >> (width - 5) << (width - 5),
            "rest": v & (top >> 3),
            "body": v >> (width - 6) & 15,
            "left": (v >> (width - 6) & 15) << (width - 4),
            "whole": v,
        }
        if run == width:
            del want["restored"]  # nothing was kept
        for k, w in want.items():
            assert r[k] == (signed(w) if k not in ("lz", "tz", "ones", "tail") else w), (k, hex(v))


@pytest.mark.parametrize("width", [16, 32, 64])
def test_binary_functions(spark, width):
    xs = patterns(width, 25)
    ys = xs[::-1]
    top = (1 << width) - 1
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([(signed(x), signed(y)) for x, y in zip(xs, ys, strict=True)], "a long, b long")
    rows = df.select(B.wrap_add(a, b, width).alias("add"), B.wrap_sub(a, b, width).alias("sub"), B.unsigned_ge(a, b, width).alias("ge"), B.abs_difference(a, b, width).alias("diff"), B.common_prefix(a, b, 20, 9, width).alias("shared")).collect()
    for x, y, r in zip(xs, ys, rows, strict=True):
        assert (r["add"], r["sub"], r["ge"], r["diff"]) == (signed((x + y) & top), signed((x - y) & top), x >= y, signed(abs(x - y)))
        assert r["shared"] == min(20, 9, lz(x ^ y, width))


@pytest.mark.parametrize("width", [16, 32, 64])
def test_patterns_of_one_run_come_back(spark, width):
    top = (1 << width) - 1
    x, tail = F.col("x"), F.col("tail")
    df = spark.createDataFrame([(signed(v),) for v in (0, top, 1, top - 1, 1 << (width - 1), top >> 1)], "x long").withColumn("tail", B.equal_tail(x, width))
    rows = df.select("x", B.drop_equal_tail(x, tail, width).alias("kept"), "tail").select("x", B.restore_equal_tail(F.col("kept"), tail, width).alias("back")).collect()
    assert [r["back"] for r in rows] == [r["x"] for r in rows]


def test_golden_value(spark):
    """1213: clear, toggle, front and suffix as a value of 32 bits."""
    x = F.col("x").cast("long")
    cleared = B.clear_lowest(x)
    toggled = B.toggle_tail(cleared, 32)
    suffixed = B.apply_suffix(F.lit(1216).cast("long"), F.lit(6), F.lit(0b11001).cast("long"), F.lit(5))
    r = spark.range(1).select(F.lit(1213).alias("x")).select(
        cleared.alias("cleared"),
        (F.lit(32) - B.trailing_zeros(cleared, 32)).alias("bits"),
        toggled.alias("toggled"),
        B.left_aligned(toggled, F.lit(21), F.lit(5), 32).alias("aligned"),
        suffixed.alias("suffixed"),
        B.left_aligned(suffixed, F.lit(21), F.lit(10), 32).alias("whole"),
    ).first()
    assert (r["cleared"], r["bits"], r["toggled"], r["suffixed"]) == (1212, 30, 1216, 1266)
    assert r["aligned"] >> 24 == 0b10011000
    assert r["whole"] >> 16 == 0b1001111001000000


@pytest.mark.parametrize("kind", [k for k in ELEMS if k not in ("uint64",)])
def test_patterns_of_values(spark, kind):
    e = elem(kind)
    if e.is_float:
        info = np.finfo(e.numpy)
        values = [0.0, -0.0, 1.5, -1.5, float(info.max), float(info.min), float(info.tiny), float(info.smallest_subnormal), float("inf"), float("-inf")]
    else:
        info = np.iinfo(e.numpy)
        values = [0, 1, int(info.min), int(info.max), 7]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], f"v {e.spark}").select("v", B.to_bits(F.col("v"), e).alias("b")).select("v", "b", B.from_bits(F.col("b"), e).alias("back")).collect()
    for v, r in zip(values, rows, strict=False):
        raw = int.from_bytes(np.array(v, e.numpy).tobytes(), "little")
        assert r["b"] == signed(raw) and repr(r["back"]) == repr(r["v"])
    assert rows[-1]["b"] is None and rows[-1]["back"] is None


def test_bitmap_and_vector_order():
    b = P.BitMap([True, False, True, True, True, True])
    b.toggle(3)
    b.clear(5)
    b.append(False)
    b.set(6)
    b.append(False)
    assert b.to_bytes() == bytes([0b01010101])
    v = P.BitVectorView(bytes([0b11010111, 0b11000010, 0b00000111, 0b01010101]))
    assert [v.next(k) for k in (2, 4, 5, 11)] == [bytes([0b11000000]), bytes([0b01010000]), bytes([0b11110000]), bytes([0b00010000, 0b00100000])]
    m = b.view()
    assert [m.next() for _ in range(8)] == [1, 0, 1, 0, 1, 0, 1, 0] and m.next() == 0


def test_serialization():
    for big in (True, False):
        assert P.deserialize(P.serialize(234, elem("uint32"), big), elem("uint32"), big) == 234
        assert P.deserialize(P.serialize(234.0, elem("double"), big), elem("double"), big) == 234.0
    assert P.to_big_endian([1, 2], elem("int16")) == b"\0\1\0\2"
    assert P.from_big_endian(b"\0\1\0\2", elem("int16")).tolist() == [1, 2]


def test_fields_of_any_width():
    r = np.random.default_rng(3)
    n = r.integers(0, 65, 500)
    v = np.array([int(x) >> (64 - int(k)) if k else 0 for x, k in zip(r.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2), n, strict=True)], np.uint64).view(np.int64)
    assert (P.unpack_fields(P.pack_fields(v, n), n) == v).all()
    assert P.pack_fields(np.zeros(0, np.int64), np.zeros(0, np.int64)) == b""
