"""Index arithmetic, domains, sub-domains, scaling, splitting and error rules, with golden values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.coords import delinearize, linearize, morton_decode, morton_encode, sub_index
from gridloom.operators import mesh as M
from gridloom.operators.grid import Grid, append, apply_scaling, cast_grid, filled, from_values, hollow, linear, slice_grid, split_by_dimension, split_table, with_morton
from gridloom.plans.domain import LAYOUTS, Domain, Hyperslab, Layout, pyramid_depth, pyramid_dims
from gridloom.plans.errors import ErrorRules

MORTON_10_BY_5 = [0, 2, 8, 10, 32, 1, 3, 9, 11, 33, 4, 6, 12, 14, 36, 5, 7, 13, 15, 37, 16, 18, 24, 26, 48, 17, 19, 25, 27, 49, 20, 22, 28, 30, 52, 21, 23, 29, 31, 53, 64, 66, 72, 74, 96, 65, 67, 73, 75, 97]


@pytest.mark.parametrize("code", LAYOUTS)
def test_layouts_there_and_back(spark, code):
    layout = Layout.by_code(code)
    assert layout.code == code and Layout.parse(layout.name) == layout
    sizes = dict(zip(("Lon", "Lat", "Lev", "Time"), (3, 4, 2, 5), strict=True))
    domain = Domain({d: (10, 10 + sizes[d]) for d in layout.dims})
    c = delinearize(layout, domain, F.col("id"))
    rows = spark.range(domain.size).select("id", *[c[a].alias(a) for a in "tzyx"]).withColumn("i", linearize(layout, domain)).collect()
    lengths = domain.lengths(layout)
    for r in rows:
        assert r["i"] == r["id"]
        assert [r[a] - 10 for a in layout.axes] == [int(k) for k in np.unravel_index(r["id"], lengths)]


def test_morton_golden(spark):
    g = from_values(spark, [100.0 + k for k in range(50)], "v", "double", "Lon_Lat", Domain.of(lon=10, lat=5), missing=-2.0)
    rows = with_morton(g).withColumn("i", linearize(g.meta.layout, g.meta.domain)).orderBy("i").collect()
    # x has the lowest bit; the golden list runs over Lon, then Lat
    assert [r["m"] for r in rows] == MORTON_10_BY_5


@pytest.mark.parametrize("dim,bits", [(1, 40), (2, 31), (3, 20), (4, 15)])
def test_morton_there_and_back(spark, dim, bits):
    r = np.random.default_rng(dim)
    points = [tuple(int(v) for v in r.integers(0, 1 << bits, dim)) for _ in range(50)] + [tuple([(1 << bits) - 1] * dim), tuple([0] * dim)]
    df = spark.createDataFrame(points, ", ".join(f"c{k} long" for k in range(dim))).withColumn("m", morton_encode(*[F.col(f"c{k}") for k in range(dim)]))
    back = df.select("*", *[c.alias(f"d{k}") for k, c in enumerate(morton_decode(F.col("m"), dim))]).collect()
    for p, row in zip(points, back, strict=True):
        assert tuple(row[f"d{k}"] for k in range(dim)) == p
        assert row["m"] == sum((c >> b & 1) << (dim * b + k) for k, c in enumerate(p) for b in range(bits))


def test_domain_algebra():
    d = Domain.of(lon=(2, 7), lat=(1, 2), time=(0, 3))
    assert (d.length("Lon"), d.dimensionality, d.size, d.largest_length()) == (5, 2, 15, 5)
    assert Domain.from_hyperslab(d.hyperslab()).same_as(d) and d.from_zero().interval("Lon") == (0, 5)
    assert d.minus(Domain.of(lon=(2, 9))).interval("Lon") == (0, 5) and d.without("Time").length("Time") == 1
    assert not d.same_as(Domain.of(lon=(2, 8), lat=(1, 2), time=(0, 3))) and d.contains(Domain.of(lon=(3, 4), lat=(1, 2), time=(1, 2)))
    assert d.with_interval("Lev", 0, 4).size == 60 and d.is_valid and not Domain.of(lon=(3, 3)).is_valid
    assert Hyperslab.of(lon=(3, 2)).size == 2 and Hyperslab.of(lon=(3, 2)).part("Lat") == (0, 1)


def test_pyramid_depth_as_in_file_headers():
    assert [pyramid_depth(n) for n in (1, 2, 3, 500, 512, 721, 1440)] == [1, 2, 2, 9, 9, 10, 11]
    assert pyramid_dims((5, 3)) == [(5, 3), (3, 2), (2, 1), (1, 1)]


def test_scaling_golden(spark):
    g = from_values(spark, [100 + k for k in range(50)], "v", "int32", "Lon_Lat", Domain.of(lon=10, lat=5), missing=-1, scale=2.0, offset=10.0)
    s = apply_scaling(g)
    assert s.meta.elem.name == "float" and [r["value"] for r in linear(s).orderBy("i").collect()] == [210.0 + 2 * k for k in range(50)]
    assert apply_scaling(Grid(g.df, g.meta.but(scale=1.0, offset=0.0))).meta.elem.name == "int32"


def test_scaling_keeps_missing_and_own_type(spark):
    g = from_values(spark, [1, -1, 3], "v", "int32", "Lon_", Domain.of(lon=3), missing=-1, scale=2.0, scale_elem="int32")
    s = apply_scaling(g)
    assert s.meta.elem.name == "int32" and [r["value"] for r in linear(s).orderBy("i").collect()] == [2, -1, 6]


def test_split_golden(spark):
    g = from_values(spark, [100.0 + k for k in range(250)], "v", "double", "Lon_Lat_Lev", Domain.of(lon=10, lat=5, lev=5))
    split = split_by_dimension(g, "Lev")
    assert sorted(split) == [0, 1, 2, 3, 4] and all(p.meta.layout.name == "Lon_Lat" and p.meta.domain.length("Lev") == 1 for p in split.values())
    assert [r["value"] for r in linear(split[1]).orderBy("i").collect()] == [101.0 + 5 * k for k in range(50)]
    assert split_table(g, "Lev").groupBy("context").count().count() == 5


def test_sub_domain_golden(spark):
    g = from_values(spark, range(16), "v", "int32", "Lat_Lon", Domain.of(lon=8, lat=2), missing=-1)
    part = slice_grid(g, Domain.of(lon=(3, 7), lat=(0, 2)))
    assert [r["value"] for r in linear(part).orderBy("i").collect()] == [3, 4, 5, 6, 11, 12, 13, 14]
    wide = slice_grid(g, Domain.of(lon=(6, 10), lat=(1, 2)))
    assert [r["value"] for r in linear(wide).orderBy("i").collect()] == [14, 15, -1, -1]
    assert slice_grid(g, Domain.of(lon=(6, 10), lat=(1, 2)), pad=False).df.count() == 2
    rows = spark.range(8).withColumnRenamed("id", "i").select(sub_index(g.meta.layout, g.meta.domain, Domain.of(lon=(6, 10), lat=(0, 2))).alias("j")).collect()
    assert [r["j"] for r in rows] == [6, 7, -1, -1, 14, 15, -1, -1]


def test_append_fill_hollow_cast(spark):
    g = from_values(spark, [1, 2, 3, 4], "v", "int16", "Lat_Lon", Domain.of(lon=2, lat=2))
    empty = hollow(g, "w")
    assert empty.df.count() == 0 and empty.meta.name == "w"
    more = spark.createDataFrame([(0, 5), (3, 6)], "i long, value int")
    assert sorted((r["y"], r["x"], r["value"]) for r in append(empty, more, index="i").df.collect()) == [(0, 0, 5), (1, 1, 6)]
    slab = spark.createDataFrame([(0, 7), (1, 8)], "i long, value int")
    assert sorted((r["y"], r["x"], r["value"]) for r in append(empty, slab, slab=Hyperslab.of(lat=(1, 1), lon=(0, 2))).df.collect()) == [(1, 0, 7), (1, 1, 8)]
    coords = spark.createDataFrame([(1, 0, 9)], "y long, x long, value int")
    assert append(empty, coords).df.first()["value"] == 9
    assert {r["value"] for r in filled(g, 3).df.collect()} == {3} and cast_grid(g, "double").df.first()["value"] in (1.0, 2.0, 3.0, 4.0)


def test_error_rules_golden(spark):
    g = from_values(spark, [0.0] * 6, "v", "float", "Lat_Lon", Domain.of(lon=3, lat=2))
    rules = ErrorRules().general("rel", 0.01).general("abs", 1.0)
    assert {(r["abs_eps"], r["rel_eps"]) for r in rules.restricting(g.df).collect()} == {(1.0, 0.01)}
    rules = rules.general("abs", 0.5).general("rel", 0.005)
    assert {(r["abs_eps"], r["rel_eps"]) for r in rules.restricting(g.df).collect()} == {(0.5, 0.005)}
    box = ErrorRules().region("abs", 0.1, Domain.of(lon=(0, 2)))
    assert sorted(r["abs_eps"] or 0 for r in box.restricting(g.df).collect()) == [0, 0, 0.1, 0.1, 0.1, 0.1]
    # an element of two halvings holds cells of the box if any of its cells lies there
    node = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 0, 1)], "t long, z long, y long, x long")
    assert [r["abs_eps"] for r in ErrorRules().region("abs", 0.1, Domain.of(lon=(3, 4))).restricting(node, 2).orderBy("x").collect()] == [0.1, None]
    with pytest.raises(ValueError):
        ErrorRules().general("abs", -1)


def test_tree_coverage_golden(spark):
    """Which cells of a uniform tree of depth 5 lie below a node."""
    cells = spark.range(1024).select(F.lit("v").alias("var"), F.col("id").alias("m"))
    for level, node, want in ((0, 100, [100]), (1, 64, [*range(256, 260)]), (2, 8, [*range(128, 144)])):
        assert sorted(r["m"] for r in M.ancestors_of(cells, 2, level).filter(F.col("up") == node).collect()) == want
    assert [r["p"] for r in cells.filter("m in (0, 255, 256, 1000)").orderBy("m").select(M.owning_part(F.col("m"), [0, 256, 512]).alias("p")).collect()] == [0, 0, 1, 2]
