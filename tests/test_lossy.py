"""Error bounds of lossy schemes, predictors against plain numpy, quality metrics."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import families as A
from gridloom.functions import truncation as T
from gridloom.operators import lossy as L
from gridloom.operators import metrics as Q
from gridloom.operators import neighbours as N
from gridloom.operators.grid import Grid, from_values, linear
from gridloom.operators.predicted import compress_predicted, decompress_predicted
from gridloom.plans.domain import Domain, Layout
from gridloom.plans.errors import ErrorRules
from gridloom.plans.types import elem


def grid(spark, values, kind, layout, dims, **meta):
    layout = Layout.parse(layout)
    return from_values(spark, values, "v", kind, layout, Domain.default(layout, dims), **meta)


def values(g):
    return [r["value"] for r in linear(g).orderBy("i").collect()]


def check(v, back, abs_eps=None, rel_eps=None):
    v, back = np.array(v, float), np.array(back, float)
    assert len(v) == len(back)
    if abs_eps is not None:
        assert (np.abs(v - back) <= abs_eps).all()
    if rel_eps is not None:
        assert (np.abs(v - back) <= rel_eps * np.abs(v) * (1 + 1e-12)).all()


CASES = [("double", (10, 5), [100.0 + k for k in range(50)], -2.0, ErrorRules().general("abs", 5.0), 5.0, None), ("float", (10, 5), [15.0 + k for k in range(50)], -200.0, ErrorRules().general("rel", 0.1), None, 0.1)]


@pytest.mark.parametrize("kind,dims,v,missing,rules,abs_eps,rel_eps", CASES)
def test_bounds_hold(spark, kind, dims, v, missing, rules, abs_eps, rel_eps):
    g = grid(spark, v, kind, "Lon_Lat", dims, missing=missing)
    elements = L.adaptive_coarsening(g, rules)
    assert elements.count() < len(v)
    check(v, values(L.expand_elements(elements, g.meta)), abs_eps, rel_eps)
    q = L.compress_quantized_prefix(g, rules)
    check(v, values(L.decompress_quantized_prefix(q)), abs_eps, rel_eps)
    t = L.compress_trimmed(g, rules)
    check(v, values(L.decompress_trimmed(t)), abs_eps, rel_eps)
    assert L.trimmed_symbols(t).filter("k = 0").count() == t.residuals.count()


def test_uniform_tree_under_a_relative_bound(spark):
    v = [float(k) for k in range(64)]
    g = grid(spark, v, "float", "Lat_Lon", (8, 8))
    check(v, values(L.expand_elements(L.adaptive_coarsening(g, ErrorRules().general("rel", 0.01)), g.meta)), rel_eps=0.01)


def test_regions_have_their_own_bounds(spark):
    r = np.random.default_rng(4)
    v = [float(x) for x in (r.standard_normal(64) * 3).astype(np.float32)]
    rules = ErrorRules().general("abs", 2.0).region("abs", 0.0, Domain.of(lat=(0, 3)))
    g = grid(spark, v, "float", "Lat_Lon", (8, 8))
    for back in (values(L.expand_elements(L.adaptive_coarsening(g, rules), g.meta)), values(L.decompress_quantized_prefix(L.compress_quantized_prefix(g, rules))), values(L.decompress_trimmed(L.compress_trimmed(g, rules)))):
        assert back[:24] == v[:24]
        check(v, back, 2.0)


def test_missing_values_stay(spark):
    v = [1.0, 1.1, -9.0, -9.0, 1.2, -9.0, -9.0, -9.0]
    g = grid(spark, v, "double", "Lat_Lon", (2, 4), missing=-9.0)
    rules = ErrorRules().general("abs", 0.5)
    back = values(L.decompress_quantized_prefix(L.compress_quantized_prefix(g, rules)))
    assert [x for x, o in zip(back, v, strict=True) if o == -9.0] == [-9.0] * 5
    assert L.adaptive_coarsening(grid(spark, [-9.0] * 8, "double", "Lat_Lon", (2, 4), missing=-9.0), rules).count() == 1


@pytest.mark.parametrize("kind", ["float", "double", "int32", "uint16"])
def test_trimming_functions(kind):
    e, r = elem(kind), np.random.default_rng(1)
    v = (r.standard_normal(500) * 50).astype(e.numpy) if e.is_float else r.integers(0, 1000, 500).astype(e.numpy)
    v[:3] = 0
    bits = T.as_bits(v, e)
    assert (T.as_values(bits, e) == v).all()
    eps = np.full(500, 1.5), np.full(500, np.nan)
    out, n = T.truncate_tails(bits, e, *eps, None)
    back = T.as_values(T.restore_tails(out, n, e.width), e)
    assert (np.abs(back.astype(float) - v.astype(float)) <= 1.5).all() and n.mean() < e.width - 2
    approx = T.as_bits((v.astype(float) + r.standard_normal(500) * 9).clip(0, 900).astype(e.numpy), e)
    less, diff, now = T.minimal_residuals(approx, bits, e, *eps)
    assert (np.abs(T.as_values(now, e).astype(float) - v.astype(float)) <= 1.5).all() and (diff == 0).any()
    exact, size = T.truncate_tails(bits, e, np.zeros(500), np.full(500, np.nan), None)
    assert (T.as_values(T.restore_tails(exact, size, e.width), e) == v).all()


def test_lone_highest_bit_is_kept():
    e = elem("int32")
    bits = T.as_bits(np.array([-(1 << 31), 0, 1], np.int32), e)
    out, n = T.truncate_tails(bits, e, np.zeros(3), np.full(3, np.nan), None)
    assert n.tolist() == [32, 0, 31] and T.as_values(T.restore_tails(out, n, 32), e).tolist() == [-(1 << 31), 0, 1]


# --- neighbours ----------------------------------------------------------------------------------------------------

def field(spark, dims, layout="Lat_Lon", kind="double"):
    r = np.random.default_rng(7)
    a = np.cumsum(r.standard_normal(math.prod(dims))).reshape(dims).astype(elem(kind).numpy)
    return a, grid(spark, [float(x) for x in a.ravel()], kind, layout, dims)


@pytest.mark.parametrize("block", [2, 32])
def test_stencil(spark, block):
    a, g = field(spark, (5, 7))
    offsets = {"l": {"x": -1}, "d": {"x": 1, "y": -1}, "far": {"y": 3}}
    rows = N.stencil(g, offsets, block).collect()
    assert len(rows) == 35
    at = lambda y, x: a[y, x] if 0 <= y < 5 and 0 <= x < 7 else None
    for r in rows:
        y, x = r["y"], r["x"]
        assert (r["value"], r["l"], r["d"], r["far"]) == (a[y, x], at(y, x - 1), at(y - 1, x + 1), at(y + 3, x))


def test_faces(spark):
    a, g = field(spark, (3, 4, 2), "Lev_Lat_Lon")
    for r in N.face_neighbours(g).collect():
        z, y, x = r["z"], r["y"], r["x"]
        near = [(z, y, x - 1), (z, y, x + 1), (z, y - 1, x), (z, y + 1, x), (z - 1, y, x), (z + 1, y, x)]
        inside = [n for n in near if all(0 <= c < s for c, s in zip(n, a.shape, strict=True))]
        assert r["faces"] == len(inside)
        assert r["in_family"] == sum(all(c // 2 == o // 2 for c, o in zip(n, (z, y, x), strict=True)) for n in inside)


def test_lorenzo(spark):
    a, g = field(spark, (4, 3, 5), "Lev_Lat_Lon")
    rows = N.lorenzo(g, 0.5).collect()
    assert len(rows) == 3 * 2 * 4
    for r in rows:
        z, y, x = r["z"], r["y"], r["x"]
        p = a[z - 1, y, x] + a[z, y - 1, x] + a[z, y, x - 1] - a[z - 1, y - 1, x] - a[z - 1, y, x - 1] - a[z, y - 1, x - 1] + a[z - 1, y - 1, x - 1]
        assert abs(r["prediction"] - p) < 1e-9 and r["zero"] == (abs((a[z, y, x] - r["prediction"]) / a[z, y, x]) <= 0.5)
    s = N.lorenzo_summary(N.lorenzo(g, 0.5)).first()
    assert s["n"] == 24 and s["rmse"] > 0


@pytest.mark.parametrize("shape, layout, block", [((6, 5), "Lat_Lon", None), ((9, 11), "Lat_Lon", 3), ((5, 6, 7), "Lev_Lat_Lon", 2), ((17,), "Lon_", 4)])
def test_lorenzo_with_feedback(spark, shape, layout, block):
    """Replaced values predict on over the borders of blocks."""
    a, g = field(spark, shape, layout)
    want, zero = a.copy(), np.zeros(a.shape, bool)
    for cell in product(*(range(1, n) for n in shape)):
        p = 0.0
        for back in product((0, 1), repeat=len(shape)):
            if any(back):
                p += (1 if sum(back) % 2 else -1) * want[tuple(c - k for c, k in zip(cell, back, strict=True))]
        if abs(p - a[cell]) <= 0.3 * abs(a[cell]):
            want[cell], zero[cell] = p, True
    rows = N.lorenzo_feedback(g, 0.3, block).collect()
    assert len(rows) == a.size and zero.any() and not zero.all()
    for r in rows:
        cell = tuple(r[x] for x in "tzyx"[4 - len(shape) :])
        assert abs(r["restored"] - want[cell]) < 1e-9 and r["zero"] == zero[cell]


def test_inverse_distances(spark):
    a, g = field(spark, (4, 6))
    for r in N.idw_prediction(g).collect():
        y, x = r["y"], r["x"]
        cy, cx = y // 2, x // 2
        near = [(cy, cx), (cy, cx - 1), (cy, cx + 1), (cy - 1, cx), (cy + 1, cx)]
        near = [(p, q) for p, q in near if 0 <= p < 2 and 0 <= q < 3]
        d = [((2 * p - y) ** 2 + (2 * q - x) ** 2) for p, q in near]
        want = a[y, x] if d[0] == 0 else sum(a[2 * p, 2 * q] / k**8 for (p, q), k in zip(near, d, strict=True)) / sum(1 / k**8 for k in d)
        assert abs(r["prediction"] - want) < 1e-9


def test_weighted_faces(spark):
    a, g = field(spark, (4, 4, 4), "Lev_Lat_Lon")
    c = a.reshape(2, 2, 2, 2, 2, 2).mean(axis=(1, 3, 5))
    for weights in (N.HEX_WEIGHTS, None):
        for r in N.face_prediction(g, A.mean(elem("double")), weights).collect():
            z, y, x = r["z"], r["y"], r["x"]
            p = (z // 2, y // 2, x // 2)
            other = [c[tuple(1 - v if k == j else v for j, v in enumerate(p))] for k in range(3)]  # both faces, as one mirrors the other
            want = c[p] / 5 + sum(other) / 6 + sum(other) / 10 if weights else (c[p] + sum(other)) / 4
            assert abs(r["prediction"] - want) < 1e-9


def test_linear_reconstruction_of_a_plane(spark):
    _, g = field(spark, (4, 4), kind="float")
    rows = N.linear_reconstruction(g).collect()
    assert len(rows) == 4 and all(0 <= r["place"] <= 5 and 0 <= r["zeros"] <= 128 for r in rows)


def test_scanline(spark):
    a, g = field(spark, (8, 8))
    lines = {r["i"]: r for r in N.scanline(N.extremes(g), length=5, bucket=6).collect()}
    assert len(lines) == 16
    for i, r in lines.items():
        start = max(0, i - 2)
        assert [p["i"] for p in r["line"]] == [*range(start, min(16, start + 5))]
    rows = N.scanline_prediction(g, length=5).collect()
    assert len(rows) == 64 and sum(r["prediction"] == r["value"] for r in rows) >= 32  # the largest and smallest of each family


def test_dense_index(spark):
    keys = sorted(int(k) for k in np.random.default_rng(2).choice(1 << 20, 300, replace=False))
    df = spark.createDataFrame([("v", k) for k in keys], "var string, m long")
    assert [r["i"] for r in N.dense_index(df, "m", bucket_bits=12).orderBy("m").collect()] == [*range(300)]


# --- quantization and metrics --------------------------------------------------------------------------------------

def test_quantized_bins(spark):
    df = spark.createDataFrame([(v, 0.0) for v in (0.0, 0.5, 0.6, 1.6, -1.6, 2043.4, -2043.4, 5000.0)], "value double, prediction double")
    assert [r["bin"] for r in L.quantize_residuals(df, 0.5).collect()] == [0, 0, 1, 2, 2047, 2043, 4088, 2045]
    hist = {r["bin"]: r["n"] for r in L.residual_histogram(df, 0.5).collect()}
    assert hist == {1: 2, 2: 1, 4: 2, 11: 3}
    left = spark.createDataFrame([(1, 0.2, 1.0), (1, -0.9, 1.0), (1, 3.0, 1.0), (2, 5.0, 1.0)], "f int, residual double, budget double")
    got = {r["f"]: r["budget"] for r in L.remaining_budget(left, ("f",)).collect()}
    assert abs(got[1] - 0.1) < 1e-12 and got[2] is None


def test_quality(spark):
    a = grid(spark, [0.0, 1.0, 2.0, 4.0], "double", "Lon_", (4,))
    b = grid(spark, [0.5, 1.0, 1.0, 4.0], "double", "Lon_", (4,))
    q = Q.quality(Q.paired(a, b), 0.75, 0.1).first()
    assert (q["n"], q["max_abs_err"], q["max_rel_err"], q["max_rel_at"], q["abs_violations"], q["rel_violations"]) == (4, 1.0, 0.5, 2, 1, 1)
    mse = (0.25 + 1.0) / 4
    assert abs(q["rmse"] - math.sqrt(mse)) < 1e-12 and abs(q["psnr"] - (20 * math.log10(4) - 10 * math.log10(mse))) < 1e-9
    e = Q.equality(Q.paired(a, b)).first()
    assert (e["equal"], e["mismatches"], e["first_mismatch"]) == (False, 2, 0)
    assert Q.equality(Q.paired(a, a)).first()["equal"] and Q.quality(Q.paired(a, a)).first()["psnr"] is None
    short = Grid(b.df.filter(F.col("x") < 3), b.meta)
    assert Q.equality(Q.paired(a, short)).first()["mismatches"] == 3


@pytest.mark.parametrize("method, dims, layout", [("near", (5, 7), "Lat_Lon"), ("distance", (6, 3), "Lat_Lon"), ("weighted", (3, 5, 4), "Lev_Lat_Lon")])
def test_coding_against_predictions(spark, method, dims, layout):
    """Every level's differences restore the grid bit by bit, and few bits are needed where predictions are near."""
    a, g = field(spark, dims, layout)
    made = compress_predicted(g, method)
    levels = {r["level"]: r["n"] for r in made.differences.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels == {k: math.prod(-(-n // 2**k) for n in dims) for k in range(g.meta.depth)}
    assert values(decompress_predicted(made)) == a.ravel().tolist()
    flat = grid(spark, [3.5] * math.prod(dims), "double", layout, dims)
    if method != "weighted":  # its weights add up to 1 only up to rounding
        assert compress_predicted(flat, method).differences.filter("nbits > 3").count() == 0
    with pytest.raises(ValueError):
        compress_predicted(g, "guess")
