"""Lossless round trips on random and special grids, families, streams, files and the command line."""

import math
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.functions import arithmetic, huffman, suffixes
from gridloom.functions import families as A
from gridloom.functions.symbols import BOUNDARY, SIGN, alphabet_size, index_symbol, symbol_index
from gridloom.functions import packing as P
from gridloom.operators import entropy as E
from gridloom.operators import mesh as M
from gridloom.operators import metrics as Q
from gridloom.operators.grid import from_values, linear
from gridloom.operators.pyramid import coarsen, compress, decompress, grid_from_cells, mean_levels
from gridloom.plans.domain import Domain, Layout
from gridloom.plans.types import elem
from gridloom.sources.binary import read_binary, write_binary
from gridloom.sources.container import read_container, write_container
from gridloom.sources.store import Store, infer_layout, read_compressed, read_grid, resolve_dimensions, write_compressed
from gridloom.streaming.slices import compress_stream


def grid(spark, values, kind, layout, dims, start=0):
    layout = Layout.parse(layout)
    domain = Domain({d: (start, start + n) for d, n in zip(layout.dims, dims, strict=True)})
    return from_values(spark, values, "v", kind, layout, domain)


def numbers(kind, n, seed=0, smooth=True):
    e, r = elem(kind), np.random.default_rng(seed)
    if e.is_float:
        return [float(x) for x in (np.cumsum(r.standard_normal(n)) if smooth else r.standard_normal(n) * 10.0 ** r.integers(-20, 20, n)).astype(e.numpy)]
    info = np.iinfo(e.numpy)
    return [int(x) for x in r.integers(info.min, info.max, n, dtype=e.numpy, endpoint=True)]


def values(g):
    return [r["value"] for r in linear(g).orderBy("i").collect()]


CASES = [("float", "Lat_Lon", (5, 7), 3), ("double", "Lon_", (9,), 0), ("int32", "Lev_Lat_Lon", (5, 3, 2), 0), ("float", "Time_Lev_Lat_Lon", (3, 2, 2, 3), 0), ("uint16", "Lat_Lon", (7, 1), 0), ("int64", "Lat_Lon", (3, 3), 0), ("float", "Lon_", (1,), 0)]


@pytest.mark.parametrize("kind,layout,dims,start", CASES)
@pytest.mark.parametrize("scheme", ["prefix", "multires"])
def test_lossless(spark, kind, layout, dims, start, scheme):
    v = numbers(kind, math.prod(dims))
    g = grid(spark, v, kind, layout, dims, start)
    assert values(decompress(compress(g, scheme))) == v


def test_lossless_special_values(spark):
    v = [0.0, -0.0, float("inf"), float("-inf"), 1e-45, -1e-45, 3.4028234663852886e38, -3.4028234663852886e38, 1.0, float("nan"), 2.0, 2.0]
    g = grid(spark, v, "float", "Lat_Lon", (3, 4))
    for scheme in ("prefix", "multires", "xor"):
        assert [repr(x) for x in values(decompress(compress(g, scheme)))] == [repr(float(np.float32(x))) for x in v]


def test_xor_takes_floats_alone(spark):
    v = numbers("double", 12, smooth=False)
    assert values(decompress(compress(grid(spark, v, "double", "Lat_Lon", (3, 4)), "xor"))) == v
    with pytest.raises(ValueError):
        compress(grid(spark, [1, 2], "int32", "Lon_", (2,)), "xor")


def test_constant_grid_has_no_residuals(spark):
    p = compress(grid(spark, [1.5] * 64, "float", "Lat_Lon", (8, 8)), "prefix")
    assert Q.level_sizes(p).agg(F.sum("payload_bits")).first()[0] == 0 and p.root.first()["len"] == 32


def test_several_variables_at_once(spark):
    a = grid(spark, numbers("float", 12, 1), "float", "Lat_Lon", (3, 4))
    b = a.df.withColumn("var", F.lit("w")).withColumn("value", F.col("value") * 2)
    both = type(a)(a.df.unionByName(b), a.meta)
    back = decompress(compress(both, "multires")).df
    assert back.exceptAll(both.df).count() == 0 and both.df.exceptAll(back).count() == 0


def test_predictor_prefers_first_of_equals(spark):
    p = compress(grid(spark, [1.0, 1.0, 1.0, 1.0], "float", "Lat_Lon", (2, 2)), "multires")
    assert {r["symbol"] for r in p.residuals.collect()} == {32}


def test_interpolations(spark):
    g = grid(spark, [1, 2, 7, 10, 7, 7], "int32", "Lat_Lon", (2, 3))
    one = lambda f: [r["value"] for r in coarsen(g, f).df.orderBy("x").collect()]
    e = elem("int32")
    assert one(A.mean(e)) == [5, 7] and one(A.mid_range(e)) == [5, 6] and one(A.upper_median(e)) == [7, 7]
    assert one(A.mean_skipping(e, 7)) == [4, 7] and one(A.mid_range_skipping(e, 7)) == [5, 7]
    assert {(r["level"], r["m"]): r["value"] for r in mean_levels(g).collect()} == {(1, 0): 5, (1, 1): 7, (2, 0): 6}


def test_embedded_with_padding_and_mesh_code(spark):
    v = numbers("double", 30)
    g = grid(spark, v, "double", "Lat_Lon", (5, 6))
    assert values(M.decompress_embedded(M.compress_embedded(g, "multires"))) == v
    elements = M.embedded_elements(g).select("var", "m", "level")
    assert elements.select(F.sum(F.expr("shiftleft(1L, 2 * level)"))).first()[0] == 64  # they tile the whole tree
    packed = M.pack_bits(M.refinement_bits(elements, 2, g.meta.depth), chunk=8)
    back = M.decode_mesh(M.unpack_bits(packed, chunk=8), 2, g.meta.depth)
    assert sorted(map(tuple, back.select("m", "level").collect())) == sorted(map(tuple, elements.select("m", "level").collect()))
    dim, depth, domain = M.read_root_record(M.root_record(g.meta))
    assert (dim, depth) == (2, 3) and domain.same_as(g.meta.domain)


def test_adaptive_forest(spark):
    rows = [("a", 0, 0, 1, 1.0)] + [("a", 0, m, 0, float(m)) for m in range(4, 16)] + [("a", 1, m, 0, float(-m)) for m in range(16)]
    df = spark.createDataFrame(rows, "var string, tree long, m long, level int, value float")
    for scheme in ("prefix", "multires"):
        back = M.decompress_forest(M.compress_forest(df, 2, 2, elem("float"), scheme))
        assert sorted(map(tuple, back.collect())) == sorted((r[0], r[1], r[2], r[4]) for r in rows)


# --- coders --------------------------------------------------------------------------------------------------------

MESSAGE = [0, 5, 4, 0, 2, 1, 6, 5, 2, 0, 3, 5, 3, 4, 6, 2, 4, 5, 5, 5, 2, 3, 7, 3, 1, 2, 5, 5, 6, 6, 2, 5, 2, 6, 7, 7]


def test_plain_message():
    cum = arithmetic.cumulative([3, 2, 7, 4, 3, 9, 5, 3])
    assert arithmetic.decode(arithmetic.encode(MESSAGE, cum), cum, len(MESSAGE)).tolist() == MESSAGE


@given(st.lists(st.integers(0, 40), max_size=200), st.integers(0, 3))
@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_message(message, more):
    f = np.bincount([*message, 41], minlength=42 + more)
    cum = arithmetic.cumulative(f)
    end = 41 if not more else None
    data = arithmetic.encode([*message, 41] if end else message, cum)
    assert arithmetic.decode(data, cum, None if end else len(message)).tolist() == message
    assert arithmetic.table_from(arithmetic.table_bytes(cum)) == cum and len(data) >= 4


@pytest.mark.parametrize("method", suffixes.ENCODERS)
@pytest.mark.parametrize("width", [8, 32, 64])
def test_suffix_encodings(method, width):
    r = np.random.default_rng(width)
    for n, fixed in ((0, False), (1, False), (50, False), (64, True)):
        lengths = np.full(n, width - 3) if fixed else r.integers(0, width + 1, n)
        bits = (r.integers(0, 1 << 63, n, dtype=np.uint64) & suffixes._ones(lengths)).view(np.int64)
        if method == "lengths":
            bits = np.where(lengths > 0, bits | 1, 0)
        got, sizes = suffixes.DECODERS[method](suffixes.ENCODERS[method](bits, lengths), lengths)
        assert (got == bits).all() and (sizes == lengths).all()


def test_huffman_is_optimal_for_powers():
    table = huffman.codes({0: 8, 1: 4, 2: 2, 3: 2})
    assert [table[k][1] for k in range(4)] == [1, 2, 3, 3] and huffman.deserialize(huffman.serialize(table)) == table
    assert huffman.codes({5: 9}) == {5: (0, 0)} and huffman.deserialize(huffman.serialize({5: (0, 0)})) == {5: (0, 0)}


@pytest.mark.parametrize("scheme", ["prefix", "multires"])
def test_alphabets(spark, scheme):
    symbols = [*range(33), BOUNDARY] + ([SIGN + k for k in range(33)] if scheme == "multires" else [])
    df = spark.createDataFrame([(s,) for s in symbols], "s long").withColumn("i", symbol_index(F.col("s"), scheme, 32))
    rows = df.withColumn("back", index_symbol(F.col("i"), scheme, 32)).collect()
    assert all(r["s"] == r["back"] for r in rows) and sorted(r["i"] for r in rows) == [*range(alphabet_size(scheme, 32))]


def test_frequencies_and_entropy(spark):
    p = compress(grid(spark, numbers("float", 64), "float", "Lat_Lon", (8, 8)), "prefix")
    f = E.symbol_frequencies(p)
    assert {(r["level"], r["n"]) for r in f.filter(F.col("symbol") == BOUNDARY).collect()} == {(k, 1) for k in range(p.depth)}
    c = E.cumulative_frequencies(f, "prefix", 32).orderBy("level", "place").collect()
    for level in range(p.depth):
        own = [r for r in c if r["level"] == level]
        counts = np.zeros(34, int)
        for r in own:
            counts[r["place"]] = r["n"]
        assert [r["upto"] for r in own] == [arithmetic.cumulative(counts)[r["place"]] for r in own]
    h = {r["level"]: r["entropy_bits"] for r in E.level_entropy(f).collect()}
    codes = {r["level"]: r["b"] for r in E.huffman_codes(f, "prefix", 32).groupBy("level").agg(F.sum(F.col("n") * F.col("code_bits")).alias("b")).collect()}
    assert all(codes[k] >= h[k] - 1e-9 for k in h)


@pytest.mark.parametrize("kind,layout,dims", [("float", "Lat_Lon", (9, 5)), ("double", "Lev_Lat_Lon", (3, 2, 4)), ("int64", "Lon_", (6,))])
@pytest.mark.parametrize("scheme", ["prefix", "multires"])
def test_files_and_streams(spark, tmp_path, kind, layout, dims, scheme):
    v = numbers(kind, math.prod(dims))
    p = compress(grid(spark, v, kind, layout, dims), scheme)
    name = write_container(p, str(tmp_path / "out"))
    c = read_container(spark, str(tmp_path / "out"), "v")
    assert os.path.basename(name) == "out_v.cmc" and c.meta.elem.name == kind and c.meta.lengths == dims
    assert values(c.decompress()) == v
    cells = E.decode(E.encode(p, chunk=7), scheme, p.meta, p.depth)
    assert values(grid_from_cells(cells.select("var", "m", "bits"), p.meta)) == v


@pytest.mark.parametrize("scheme", ["prefix", "multires"])
def test_files_are_made_of_pieces(spark, tmp_path, monkeypatch, scheme):
    from gridloom.sources import container

    v = numbers("double", 99)
    p = compress(grid(spark, v, "double", "Lat_Lon", (11, 9)), scheme)
    whole = open(write_container(p, str(tmp_path / "whole")), "rb").read()
    for module in (container, E):
        monkeypatch.setattr(module, "CHUNK", 7)  # cells
    monkeypatch.setattr(container, "BLOCK", 50)  # bytes
    assert open(write_container(p, str(tmp_path / "cut")), "rb").read() == whole
    c = read_container(spark, str(tmp_path / "cut"), "v")
    assert c.blocks.count() == -(-len(whole) // 50) and values(c.decompress()) == v


def test_memory_of_fields_is_by_field_and_not_by_bit():
    import tracemalloc

    v, n = np.arange(50_000), np.full(50_000, 64)
    tracemalloc.start()
    assert (P.unpack_fields(P.pack_fields(v, n), n) == v).all()
    assert tracemalloc.get_traced_memory()[1] < 250 * len(v)
    tracemalloc.stop()


def test_file_header(spark, tmp_path):
    p = compress(grid(spark, numbers("float", 6), "float", "Lat_Lon", (2, 3)), "prefix")
    data = open(write_container(p, str(tmp_path / "h")), "rb").read()
    assert np.frombuffer(data, ">i4", 12).tolist() == [4, 16, 6, 2, 3, 3, 1, 1, 1, 2, 2, 3]


def test_compressed_store(spark, tmp_path):
    v = numbers("float", 35)
    write_compressed(compress(grid(spark, v, "float", "Lat_Lon", (5, 7), 4), "prefix"), str(tmp_path / "c"), chunk=8)
    assert values(read_compressed(spark, str(tmp_path / "c"), "v")) == v


def test_binary_files(spark, tmp_path):
    v = [*range(16)]
    g = grid(spark, v, "int32", "Lat_Lon", (2, 8))
    path = str(tmp_path / "a.bin")
    write_binary(g, path)
    assert np.fromfile(path, np.int32).tolist() == v
    assert values(read_binary(spark, path, "int32_t", "v", "Lat_Lon", g.meta.domain)) == v
    sub = read_binary(spark, path, "int32", "v", "Lat_Lon", g.meta.domain, -1, Domain.of(lon=(3, 7), lat=(0, 2)))
    assert values(sub) == [3, 4, 5, 6, 11, 12, 13, 14]
    with pytest.raises(ValueError):
        read_binary(spark, path, "int32", "v", "Lat_Lon", Domain.of(lon=8, lat=3))


def test_command_line(spark, tmp_path, capsys):
    v = np.cumsum(np.random.default_rng(1).standard_normal(24)).astype(np.float32)
    v.tofile(tmp_path / "in.bin")
    a, b = str(tmp_path / "in.bin"), str(tmp_path / "back.bin")
    assert cli.main(["compress", "-t", "float", "-i", a, "-o", str(tmp_path / "p"), "-v", "w", "-d", "3", "-s", "2 3 4", "--scheme", "multires"]) == 0
    assert cli.main(["decompress", "-t", "float", "-i", str(tmp_path / "p"), "-o", b, "-v", "w"]) == 0
    assert cli.main(["compare", "-t", "float", "-i", a, "-o", b]) == 0 and "equal" in capsys.readouterr().out
    c = str(tmp_path / "other.bin")
    (v + 1).astype(np.float32).tofile(c)
    assert cli.main(["compare", "-t", "float", "-i", a, "-o", c]) == 1
    with pytest.raises(ValueError):
        cli.decompress_file(spark, "double", str(tmp_path / "p"), b, "w")


def test_store(spark, tmp_path):
    g = from_values(spark, [1.0, 2.0, 4.0, 8.0, 16.0, 32.0], "v", "double", "Lat_Lon", Domain.of(lat=2, lon=3), missing=-7.5)
    s = Store(spark, str(tmp_path / "s"))
    s.write([g], {"v": {"attr": 1.5, "id": 3}}, {"global_attr": 255})
    assert s.variables() == ["v"] and s.attributes("v") == {"attr": 1.5, "id": 3} and s.attributes() == {"global_attr": 255}
    assert s.meta("v").missing == -7.5 and values(s.read("v")) == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
    assert values(s.read("v", Domain.of(lon=(1, 3)))) == [2.0, 4.0, 16.0, 32.0]
    s.stash_for_reading("v", Domain.of(lon=(0, 1)), Domain.of(lon=(2, 3), lat=(1, 2)))
    assert sorted(r["value"] for r in s.read_stashed()[0].df.collect()) == [1.0, 8.0, 32.0] and not s.stash
    with pytest.raises(ValueError):
        s.meta("nothing")


def test_wide_tables(spark, tmp_path):
    rows = [(0, k // 3, k % 3, float(k), k) for k in range(6)]
    spark.createDataFrame(rows, "Time long, latitude long, Longitude long, temp double, n int").write.parquet(str(tmp_path / "w"))
    a, b = read_grid(spark, str(tmp_path / "w"), ["temp", "n"])
    assert a.meta.layout.name == "Lat_Lon" and b.meta.elem.name == "int32" and values(a) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    (part,) = read_grid(spark, str(tmp_path / "w"), ["n"], Domain.of(lon=(1, 3)))
    assert values(part) == [1, 2, 4, 5]
    assert resolve_dimensions(["a", "LAT"], {"Lon": "a"}) == {"Lon": "a", "Lat": "LAT"}
    assert infer_layout(["lon", "lev"], {"Lon": "lon", "Lev": "lev"}).name == "Lon_Lev"


def test_stream_of_slices(spark, tmp_path):
    schema = "var string, t long, z long, y long, x long, value float"
    for t in range(2):
        rows = [("v", t, 0, k // 4, k % 4, float(k * (t + 1))) for k in range(16)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    meta = grid(spark, [0.0] * 16, "float", "Lat_Lon", (4, 4)).meta
    cells = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = compress_stream(cells, meta, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("t", "level").agg(F.sum("n").alias("n")).orderBy("t", "level").collect()
    assert [(r["t"], r["level"], r["n"]) for r in out] == [(t, k, n) for t in range(2) for k, n in ((0, 16), (1, 4))]
