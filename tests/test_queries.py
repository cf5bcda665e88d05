"""Every registered grid query against its SQL twin, and the contract of the entry module."""

import re
from pathlib import Path

import oracle
import pytest
from conftest import SMALLEST

import __spark_entry__
from gridloom import queries as grids

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALLEST)


@pytest.fixture(scope="module", autouse=True)
def shared_pyramids():
    """Queries over the same grid and scheme share one pyramid here, to save time."""
    made, real = {}, grids.compress

    def once(grid, scheme="prefix", folder=None):
        key = (repr(grid.meta), scheme)
        if key not in made:
            made[key] = real(grid, scheme, folder)
        return made[key]

    grids.compress = once
    yield
    grids.compress = real


@pytest.mark.parametrize("name", sorted(grids.oracle_sql()))
def test_against_sql(spark, con, name):
    assert oracle.compare(grids.queries()[name](spark, SMALLEST), con, grids.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(grids.queries()) - set(grids.oracle_sql())))
def test_without_sql(spark, name):
    assert grids.queries()[name](spark, SMALLEST).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["level", "n", "payload_bits", "payload_bytes"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_training_data_package():
    for p in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s+gridloom\.llm", p.read_text(), re.M), p


def test_filters_and_columns_reach_the_scan(spark):
    plan = grids.hyperslab_filter(spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,100)" in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_several_levels_take_one_shuffle(spark):
    from gridloom.operators.pyramid import PrefixScheme, cells_of, climb

    cells = PrefixScheme(grids.elem("float")).start(cells_of(grids.vectors(spark, SMALLEST))).select("var", "m", "bits", "len")
    plan = climb(cells, 2, 0, 3, PrefixScheme(grids.elem("float")).step)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", plan)) == 1 and len(re.findall(r"\bWindow \[", plan)) >= 3


def test_suffixes_move_once_for_all_encoders(spark):
    plan = grids.suffix_encodings(spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_long_grids_are_walked_in_few_waves():
    from gridloom.operators.neighbours import _walked_sides

    for shape in ((360_000, 100), (6000, 6000), (90_000, 20, 20), (36_000, 10, 10, 10), (36_000_000,)):
        assert sum(-(-n // k) - 1 for n, k in zip(shape, _walked_sides(shape), strict=True)) < 80


def test_mesh_bits_are_read_once(spark):
    from gridloom.operators import mesh as M

    grid = grids.events(spark, SMALLEST, "Lat_Lon")
    elements = M.embedded_elements(grid).select("var", "m", "level")
    bits, seen = M.unpack_bits(M.pack_bits(M.refinement_bits(elements, 2, grid.meta.depth))), spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    counted = bits.mapInPandas(count, bits.schema)
    assert M.decode_mesh(counted, 2, grid.meta.depth).count() == elements.count() and seen.value == bits.count()


def test_scanlines_are_not_moved_with_cells(spark):
    plan = grids.scanline_predict(spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_residuals_are_counted_once_and_records_decoded_once(spark, monkeypatch):
    from gridloom.operators import entropy as E

    p = grids.compress(grids.vectors(spark, SMALLEST), "multires")
    scans = p.residuals._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert E.symbol_frequencies(p)._jdf.queryExecution().executedPlan().toString().count("FileScan") == scans
    cells = E.decode(E.encode(p, 8192), "multires", p.meta, p.depth)
    assert "MapInPandas" not in cells._jdf.queryExecution().executedPlan().toString()
