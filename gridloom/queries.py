"""The registered queries of grids over the test tables, each beside its SQL twin where SQL can express it.

Grids: ``embeddings`` as Lat (``vec_id``) by Lon (place in the vector), float; ``events.value`` by ``event_id`` as one to three
dimensions, double; ``part`` by ``p_partkey`` in two, int32 sizes and prices. The number of rows is all that varies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import bits as B
from gridloom.functions import families as A
from gridloom.functions import suffixes
from gridloom.functions.coords import delinearize, linearize, morton_decode, morton_encode, morton_of, sub_index
from gridloom.operators import entropy as E
from gridloom.operators import lossy as L
from gridloom.operators import mesh as M
from gridloom.operators import metrics as Q
from gridloom.operators import neighbours as N
from gridloom.operators import predicted as P
from gridloom.operators.grid import Grid, append, apply_scaling, cast_grid, filled, grid_of, hollow, linear, slice_grid, split_table
from gridloom.operators.pyramid import Pyramid, cells_of, coarsen, compress, decompress, mean_levels
from gridloom.plans.domain import Domain, Layout
from gridloom.plans.errors import ErrorRules
from gridloom.plans.storage import shared_folder
from gridloom.plans.types import elem

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- grids ---------------------------------------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> Grid:
    """Lat_Lon floats: a row per vector."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value"))
    rows = (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    return grid_of(df, "vectors", "float", "Lat_Lon", Domain.of(lat=rows, lon=64))


def events(spark: SparkSession, sf_dir: str, layout: str) -> Grid:
    """Doubles by event: Lon_ of all, Lat_Lon of rows of 100, or Lev_Lat_Lon of planes of 20 by 20."""
    layout = Layout.parse(layout)
    src = table(spark, sf_dir, "events").select("event_id", "value")
    n = (src.agg(F.max("event_id")).first()[0] or 0) + 1
    inner = {1: [], 2: [100], 3: [20, 20]}[layout.dimensionality]
    size = 1
    for k in inner:
        size *= k
    domain = Domain.default(layout, [-(-n // size), *inner])
    return grid_of(src, "events", "double", layout, domain, coords=delinearize(layout, domain, F.col("event_id")))


def parts(spark: SparkSession, sf_dir: str, value: str = "p_size", kind: str = "int32") -> Grid:
    """Lat_Lon: rows of 50 parts."""
    src = table(spark, sf_dir, "part").select(F.col("p_partkey"), F.col(value).alias("v"))
    n = (src.agg(F.max("p_partkey")).first()[0] or 0) + 1
    layout = Layout.parse("Lat_Lon")
    domain = Domain.default(layout, [-(-n // 50), 50])
    return grid_of(src, "parts", kind, layout, domain, "v", delinearize(layout, domain, F.col("p_partkey")))


_V = "(SELECT vec_id AS y, unnest(range(len(embedding))) AS x, unnest(embedding) AS v FROM embeddings)"
_E2 = "(SELECT event_id // 100 AS y, event_id % 100 AS x, value AS v FROM events)"
_E3 = "(SELECT event_id // 400 AS z, (event_id // 20) % 20 AS y, event_id % 20 AS x, value AS v FROM events)"
_P2 = "(SELECT p_partkey // 50 AS y, p_partkey % 50 AS x, p_size AS v FROM part)"
_BITS = "(CAST(CAST(CAST(v AS FLOAT) AS BIT) AS INTEGER)::BIGINT & 4294967295)"


def _lz(x: str, width: int = 32) -> str:
    return f"({width} - length(ltrim(bin({x}), '0')))"


def _morton(*axes: str) -> str:
    """Interleaves 14 bits of each axis, the first lowest."""
    d = len(axes)
    terms = " | ".join(f"(((({a})::BIGINT >> b) & 1) << ({d} * b + {k}))" for k, a in enumerate(axes))
    return f"list_sum(list_transform(range(0, 14), lambda b: {terms}))::BIGINT"


# --- index arithmetic ----------------------------------------------------------------------------------------------

@query("delinearize_grid", "SELECT event_id, event_id // 400 AS z, (event_id // 20) % 20 AS y, event_id % 20 AS x FROM events")
def delinearize_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = events(spark, sf_dir, "Lev_Lat_Lon")
    c = delinearize(grid.meta.layout, grid.meta.domain, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", *[c[a].alias(a) for a in ("z", "y", "x")])


@query("linearize_grid", f"SELECT y, x, x * (SELECT max(vec_id) + 1 FROM embeddings) + y AS i FROM {_V}")
def linearize_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = vectors(spark, sf_dir)
    return grid.df.select("y", "x", linearize(Layout.parse("Lon_Lat"), grid.meta.domain).alias("i"))


@query("morton_2d", f"SELECT y, x, {_morton('x', 'y')} AS m FROM {_V}")
def morton_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).df.select("y", "x", morton_encode(F.col("x"), F.col("y")).alias("m"))


@query("morton_3d", f"SELECT z, y, x, {_morton('x', 'y', 'z')} AS m FROM {_E3}")
def morton_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = events(spark, sf_dir, "Lev_Lat_Lon")
    return grid.df.select("z", "y", "x", morton_of(grid.axes).alias("m"))


@query("morton_roundtrip", f"SELECT z, y, x FROM {_E3}")
def morton_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = events(spark, sf_dir, "Lev_Lat_Lon")
    x, y, z = morton_decode(F.col("m"), 3)
    return grid.df.select(morton_of(grid.axes).alias("m")).select(z.alias("z"), y.alias("y"), x.alias("x"))


@query("hyperslab_filter", f"SELECT y, x, v AS value FROM {_V} WHERE y >= 100 AND y < 150 AND x >= 8 AND x < 40")
def hyperslab_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_grid(vectors(spark, sf_dir), Domain.of(lat=(100, 150), lon=(8, 40)), pad=False).df.select("y", "x", "value")


@query(
    "hyperslab_pad_missing",
    f"""SELECT s.y, s.x, coalesce(g.v, -2.0::FLOAT) AS value
    FROM (SELECT a.y, b.x FROM (SELECT unnest(range((SELECT max(vec_id) - 19 FROM embeddings), (SELECT max(vec_id) + 21 FROM embeddings))) AS y) a, (SELECT unnest(range(60, 70)) AS x) b) s
    LEFT JOIN {_V} g ON g.y = s.y AND g.x = s.x""",
)
def hyperslab_pad_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = vectors(spark, sf_dir)
    n = grid.meta.domain.length("Lat")
    grid = Grid(grid.df, grid.meta.but(missing=-2.0))
    return slice_grid(grid, Domain.of(lat=(n - 20, n + 20), lon=(60, 70))).df.select("y", "x", "value")


@query(
    "sub_domain_indices",
    """WITH n AS (SELECT max(event_id) // 100 + 1 AS rows FROM events), s AS (SELECT unnest(range(0, 40 * 12)) AS i)
    SELECT i, CASE WHEN rows - 20 + i // 12 BETWEEN 0 AND rows - 1 AND 95 + i % 12 < 100 THEN (rows - 20 + i // 12) * 100 + 95 + i % 12 ELSE -1 END AS j FROM s, n""",
)
def sub_domain_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = events(spark, sf_dir, "Lat_Lon").meta
    n = meta.domain.length("Lat")
    sub = Domain.of(lat=(n - 20, n + 20), lon=(95, 107))
    return spark.range(sub.size).withColumnRenamed("id", "i").select("i", sub_index(meta.layout, meta.domain, sub).alias("j"))


@query("scale_offset", "SELECT p_partkey // 50 AS y, p_partkey % 50 AS x, (CASE WHEN p_size = 1 THEN 1 ELSE 2 * p_size + 10 END)::FLOAT AS value FROM part")
def scale_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = parts(spark, sf_dir)
    return apply_scaling(Grid(grid.df, grid.meta.but(missing=1, scale=2.0, offset=10.0))).df.select("y", "x", "value")


@query("split_by_dim", f"SELECT z::INTEGER AS context, y, x, {_morton('x', 'y')} AS m, v AS value FROM {_E3}")
def split_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_table(events(spark, sf_dir, "Lev_Lat_Lon"), "Lev").select(F.col("context").cast("int").alias("context"), "y", "x", "m", "value")


@query("dense_index", f"SELECT y, x, row_number() OVER (ORDER BY {_morton('x', 'y')}) - 1 AS i FROM {_E2}")
def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = events(spark, sf_dir, "Lat_Lon")
    rows = grid.df.withColumn("m", morton_of(grid.axes))
    return N.dense_index(rows, "m", bucket_bits=6).select("y", "x", "i")


# --- bits ----------------------------------------------------------------------------------------------------------

def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).df.select("y", "x", B.to_bits(F.col("value"), elem("float")).alias("bits"))


@query("float_bits", f"SELECT y, x, {_BITS} AS bits FROM {_V}")
def float_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bits(spark, sf_dir)


@query(
    "lzc_tzc",
    f"""SELECT y, x, ({_lz('b')})::INTEGER AS leading, (CASE WHEN b = 0 THEN 32 ELSE bit_count((b & -b) - 1) END)::INTEGER AS trailing,
    bit_count(((4294967295 - b) & -(4294967295 - b)) - 1)::INTEGER AS ones FROM (SELECT y, x, {_BITS} AS b FROM {_V}) WHERE b <> 4294967295""",
)
def lzc_tzc(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bits")
    return _bits(spark, sf_dir).select("y", "x", B.leading_zeros(b, 32).alias("leading"), B.trailing_zeros(b, 32).alias("trailing"), B.trailing_ones(b, 32).alias("ones"))


@query("clear_tail", f"SELECT y, x, b & (b - 1) AS bits FROM (SELECT y, x, {_BITS} AS b FROM {_V}) WHERE b <> 0 UNION ALL SELECT y, x, 0 FROM (SELECT y, x, {_BITS} AS b FROM {_V}) WHERE b = 0")
def clear_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bits(spark, sf_dir).withColumn("bits", B.clear_lowest(F.col("bits")))


@query("toggle_tail", f"SELECT y, x, (b + (b & -b)) & 4294967295 AS bits FROM (SELECT y, x, {_BITS} AS b FROM {_V})")
def toggle_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bits(spark, sf_dir).withColumn("bits", B.toggle_tail(F.col("bits"), 32))


@query(
    "common_prefix_pairs",
    f"""WITH b AS (SELECT y, x, {_BITS} AS b FROM {_V})
    SELECT a.y, a.x, ({_lz('xor(a.b, c.b)')})::INTEGER AS shared FROM b a JOIN b c ON a.y = c.y AND a.x + 1 = c.x""",
)
def common_prefix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = vectors(spark, sf_dir)
    rows = N.stencil(grid, {"right": {"x": 1}}).filter(F.col("right").isNotNull())
    rows = rows.select("y", "x", B.to_bits(F.col("value"), elem("float")).alias("a"), B.to_bits(F.col("right"), elem("float")).alias("b"))
    return rows.select("y", "x", B.common_prefix(F.col("a"), F.col("b"), 32, 32, 32).alias("shared"))


# --- families and pyramids -----------------------------------------------------------------------------------------

@query("family_mean", f"SELECT y // 2 AS y, x // 2 AS x, avg(v::DOUBLE)::FLOAT AS value FROM {_V} GROUP BY ALL")
def family_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen(vectors(spark, sf_dir), A.mean(elem("float"))).df.select("y", "x", "value")


@query("family_midrange", f"SELECT y // 2 AS y, x // 2 AS x, (max(v)::DOUBLE / 2 + min(v)::DOUBLE / 2)::FLOAT AS value FROM {_V} GROUP BY ALL")
def family_midrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen(vectors(spark, sf_dir), A.mid_range(elem("float"))).df.select("y", "x", "value")


@query("family_mean_skip_missing", f"SELECT y // 2 AS y, x // 2 AS x, coalesce(trunc(avg(CASE WHEN v <> 7 THEN v::DOUBLE END))::INTEGER, 7) AS value FROM {_P2} GROUP BY ALL")
def family_mean_skip_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen(parts(spark, sf_dir), A.mean_skipping(elem("int32"), 7)).df.select("y", "x", "value")


@query("family_midrange_skip_missing", f"SELECT y // 2 AS y, x // 2 AS x, coalesce(trunc((max(v) FILTER (v <> 7) + min(v) FILTER (v <> 7)) / 2.0)::INTEGER, 7) AS value FROM {_P2} GROUP BY ALL")
def family_midrange_skip_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen(parts(spark, sf_dir), A.mid_range_skipping(elem("int32"), 7)).df.select("y", "x", "value")


@query("family_median", f"SELECT y // 2 AS y, x // 2 AS x, list_sort(list(v))[len(list(v)) // 2 + 1] AS value FROM {_V} GROUP BY ALL")
def family_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarsen(vectors(spark, sf_dir), A.upper_median(elem("float"))).df.select("y", "x", "value")


_MEANS = "WITH l0 AS (SELECT y, x, v FROM " + _V + ")" + "".join(f", l{k} AS (SELECT y // 2 AS y, x // 2 AS x, avg(v::DOUBLE)::FLOAT AS v FROM l{k - 1} GROUP BY ALL)" for k in range(1, 5))


@query("pyramid_mean_levels", _MEANS + " " + " UNION ALL ".join(f"SELECT {k} AS level, {_morton('x', 'y')} AS m, v AS value FROM l{k}" for k in range(1, 5)))
def pyramid_mean_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_levels(vectors(spark, sf_dir), 4).select("level", "m", "value")


#: Levels of the prefix pyramid: l_k has what stands at level k, r_k the residual lengths against level k + 1.
_LEVELS = 12
_DEPTH = "(SELECT ceil(log2(greatest(max(vec_id) + 1, 64)))::INTEGER FROM embeddings)"
_PREFIX = (
    f"WITH l0 AS (SELECT y, x, {_BITS} AS b, 32 AS n FROM {_V})"
    + "".join(
        f""", f{k} AS (SELECT y // 2 AS y, x // 2 AS x, bit_or(b) AS o, bit_and(b) AS a, min(n) AS least FROM l{k} GROUP BY ALL),
    p{k} AS (SELECT y, x, o, least({_lz('xor(o, a)')}, least)::INTEGER AS n FROM f{k}),
    r{k} AS (SELECT {k} AS level, l.y, l.x, l.n - p.n AS nbits FROM l{k} l JOIN p{k} p ON l.y // 2 = p.y AND l.x // 2 = p.x),
    l{k + 1} AS (SELECT y, x, (o >> (32 - n)) << (32 - n) AS b, n FROM p{k})"""
        for k in range(_LEVELS)
    )
    + ", r AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(_LEVELS))
    + f") WHERE level < {_DEPTH})"
)


@query("prefix_pyramid_sizes", _PREFIX + " SELECT level, count(*) AS n, sum(nbits)::BIGINT AS payload_bits, ceil(sum(nbits) / 8)::BIGINT AS payload_bytes FROM r GROUP BY level")
def prefix_pyramid_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.level_sizes(compress(vectors(spark, sf_dir), "prefix")).drop("var")


@query(
    "prefix_level1",
    f"""WITH l AS (SELECT y, x, {_BITS} AS b FROM {_V}), p AS (SELECT y // 2 AS y, x // 2 AS x, ({_lz('xor(bit_or(b), bit_and(b))')})::INTEGER AS n FROM l GROUP BY ALL)
    SELECT {_morton('l.x', 'l.y')} AS m, 32 - n AS nbits, CASE WHEN n = 32 THEN 0 ELSE b & ((1::BIGINT << (32 - n)) - 1) END AS payload FROM l JOIN p ON l.y // 2 = p.y AND l.x // 2 = p.x""",
)
def prefix_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_level(vectors(spark, sf_dir), "prefix").residuals.filter("level = 0").select("m", "nbits", "payload")


def _one_level(grid: Grid, scheme: str) -> Pyramid:
    from gridloom.operators.pyramid import SCHEMES, compress_cells

    return compress_cells(cells_of(grid), grid.meta.dimensionality, 1, SCHEMES[scheme](grid.meta.elem), grid.meta)


@query("suffix_bits_by_level", _PREFIX + " SELECT level, nbits, count(*) AS n FROM r GROUP BY level, nbits")
def suffix_bits_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(vectors(spark, sf_dir), "prefix").residuals.groupBy("level", "nbits").agg(F.count("*").alias("n"))


_CANDIDATES = f"""WITH l AS (SELECT y, x, v, {_BITS} AS b, {_morton('x', 'y')} AS m FROM {_V}),
    f AS (SELECT y // 2 AS y, x // 2 AS x, list(b ORDER BY m) AS fam, max(v) AS hi, min(v) AS lo, avg(v::DOUBLE)::FLOAT AS mean FROM l GROUP BY ALL),
    g AS (SELECT y, x, fam, len(fam) AS n, CASE WHEN len(fam) = 1 THEN hi ELSE (hi::DOUBLE / 2 + lo::DOUBLE / 2)::FLOAT END AS v, mean FROM f),
    h AS (SELECT y, x, fam, n, {_BITS} AS mid, mean AS v FROM g),
    c AS (SELECT y, x, fam, n, mid, {_BITS} AS mean FROM h),"""
_MULTIRES = (
    _CANDIDATES
    + f""" t AS (SELECT y, x, fam, unnest(range(1, n + 3)) AS k, unnest(list_concat(fam, [mid, mean])) AS c FROM c),
    s AS (SELECT y, x, k, c, fam, list_sum(list_transform(fam, lambda b: {_lz('abs(b - c)')})) AS score FROM t),
    best AS (SELECT y, x, arg_max(struct_pack(k := k, c := c), score * 100 - k) AS p FROM s GROUP BY y, x)"""
)


@query("multires_predictor", _MULTIRES + f" SELECT {_morton('x', 'y')} AS m, p.c AS bits FROM best")
def multires_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_level(vectors(spark, sf_dir), "multires").root.select("m", "bits")


@query(
    "multires_residuals",
    _MULTIRES
    + f""", r AS (SELECT l.m, p.c AS a, l.b, abs(p.c - l.b) AS d FROM l JOIN best ON l.y // 2 = best.y AND l.x // 2 = best.x),
    q AS (SELECT m, d, {_lz('d')} AS lz, a < b AS added FROM r)
    SELECT m, greatest(31 - lz, 0)::INTEGER AS nbits, CASE WHEN lz >= 31 THEN 0 ELSE d & ((1::BIGINT << (31 - lz)) - 1) END AS payload,
      (lz + CASE WHEN added AND lz < 32 THEN 1073741824 ELSE 0 END)::BIGINT AS symbol FROM q""",
)
def multires_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_level(vectors(spark, sf_dir), "multires").residuals.filter("level = 0").select("m", "nbits", "payload", "symbol")


@query(
    "xor_predictor",
    _CANDIDATES
    + f""" t AS (SELECT y, x, fam, n, unnest(range(1, n + 3)) AS k, unnest(list_concat(fam, [mid, mean])) AS c FROM c),
    s AS (SELECT y, x, n, k, c, {_lz('list_reduce(list_transform(fam, lambda b: xor(b, c)), lambda p, q: p | q)')} AS z FROM t),
    best AS (SELECT y, x, arg_max(struct_pack(c := c, z := z), z * 100 + CASE WHEN k <= n THEN 50 - k WHEN k = n + 2 THEN 2 ELSE 1 END) AS p FROM s GROUP BY y, x)
    SELECT {_morton('x', 'y')} AS m, p.c AS bits, least(p.z, 15)::BIGINT AS code FROM best""",
)
def xor_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _one_level(vectors(spark, sf_dir), "xor")
    codes = p.residuals.filter(F.col("symbol").isNotNull()).select(B.shr(F.col("m"), 2).alias("m"), F.col("symbol").alias("code"))
    return p.root.select("m", "bits").join(codes, "m")


@query(
    "symbol_frequencies",
    _PREFIX + " SELECT level, nbits::BIGINT AS symbol, count(*) AS n FROM r GROUP BY level, nbits UNION ALL SELECT DISTINCT level, 2147483648::BIGINT, 1 FROM r",
)
def symbol_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.symbol_frequencies(compress(vectors(spark, sf_dir), "prefix")).drop("var")


_CUMULATIVE = (
    _PREFIX
    + """, s AS (SELECT level, nbits AS place, count(*) AS n FROM r GROUP BY level, nbits UNION ALL SELECT DISTINCT level, 33, 1 FROM r),
    t AS (SELECT level, place, n, greatest(floor(n::DOUBLE / (sum(n) OVER (PARTITION BY level)::DOUBLE / 16350.0)), 1)::BIGINT AS scaled FROM s)"""
)


@query("cumulative_frequencies", _CUMULATIVE + " SELECT level, place::INTEGER AS place, n, scaled, (sum(scaled) OVER (PARTITION BY level ORDER BY place))::BIGINT AS upto FROM t")
def cumulative_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = E.symbol_frequencies(compress(vectors(spark, sf_dir), "prefix"))
    return E.cumulative_frequencies(f, "prefix", 32).select("level", "place", "n", "scaled", "upto")


@query(
    "level_entropy",
    _PREFIX
    + """, s AS (SELECT level, nbits, count(*) AS n FROM r GROUP BY level, nbits), t AS (SELECT *, sum(n) OVER (PARTITION BY level) AS total FROM s)
    SELECT level, sum(n)::BIGINT AS symbols, round(sum(-n * log2(n / total)), 3) + 0.0 AS entropy_bits FROM t GROUP BY level""",
)
def level_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.level_entropy(E.symbol_frequencies(compress(vectors(spark, sf_dir), "prefix")))
    return out.select("level", "symbols", (F.round("entropy_bits", 3) + F.lit(0.0)).alias("entropy_bits"))


@query(
    "level_byte_offsets",
    _PREFIX
    + """, s AS (SELECT level, ceil(sum(nbits) / 8)::BIGINT AS payload_bytes FROM r GROUP BY level)
    SELECT level, payload_bytes, coalesce(sum(payload_bytes) OVER (ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM s""",
)
def level_byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.level_byte_offsets(Q.level_sizes(compress(vectors(spark, sf_dir), "prefix"))).select("level", "payload_bytes", "byte_offset")


@query("rollup_tiles", f"SELECT y // 64 AS tile, y // 8 AS strip, count(*) AS n, sum(v)::BIGINT AS total FROM {_P2} GROUP BY ROLLUP (y // 64, y // 8)")
def rollup_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parts(spark, sf_dir).df.select(F.expr("y div 64").alias("tile"), F.expr("y div 8").alias("strip"), "value")
    return df.rollup("tile", "strip").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# --- lossless round trips ------------------------------------------------------------------------------------------

@query("roundtrip_prefix", f"SELECT y, x, v AS value FROM {_V}")
def roundtrip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompress(compress(vectors(spark, sf_dir), "prefix")).df.select("y", "x", "value")


@query("roundtrip_multires", f"SELECT y, x, v AS value FROM {_V}")
def roundtrip_multires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompress(compress(vectors(spark, sf_dir), "multires")).df.select("y", "x", "value")


@query("roundtrip_xor", f"SELECT y, x, v AS value FROM {_E2}")
def roundtrip_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompress(compress(events(spark, sf_dir, "Lat_Lon"), "xor")).df.select("y", "x", "value")


@query("roundtrip_prefix_1d", "SELECT event_id AS x, value FROM events")
def roundtrip_prefix_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompress(compress(events(spark, sf_dir, "Lon_"), "prefix")).df.select("x", "value")


@query("roundtrip_multires_3d", f"SELECT z, y, x, v AS value FROM {_E3}")
def roundtrip_multires_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompress(compress(events(spark, sf_dir, "Lev_Lat_Lon"), "multires")).df.select("z", "y", "x", "value")


@query("roundtrip_embedded", f"SELECT z, y, x, v AS value FROM {_E3}")
def roundtrip_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.decompress_embedded(M.compress_embedded(events(spark, sf_dir, "Lev_Lat_Lon"), "prefix")).df.select("z", "y", "x", "value")


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest: one tree of 8 by 8 cells per vector, whose first quarter is one coarse element if its vector's number is even."""
    df = table(spark, sf_dir, "embeddings").select(F.lit("f").alias("var"), F.col("vec_id").alias("tree"), F.posexplode("embedding").alias("p", "value"))
    df = df.select("var", "tree", F.col("p").cast("long").alias("m"), "value")
    coarse = (F.col("tree") % 2 == 0) & (F.col("m") < 16)
    return df.filter(~coarse | (F.col("m") == 0)).withColumn("level", F.when(coarse, 2).otherwise(0))


@query("roundtrip_forest", "SELECT vec_id AS tree, p AS m, v AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM embeddings) WHERE NOT (vec_id % 2 = 0 AND p > 0 AND p < 16)")
def roundtrip_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.compress_forest(forest(spark, sf_dir), 2, 3, elem("float"), "multires")
    return M.decompress_forest(p).select("tree", "m", "value")


@query("container_roundtrip", f"SELECT y, x, v AS value FROM {_E2}")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.sources.container import read_container, write_container

    prefix = f"{shared_folder(spark)}/events"
    write_container(compress(events(spark, sf_dir, "Lat_Lon"), "prefix"), prefix)
    return read_container(spark, prefix, "events").decompress().df.select("y", "x", "value")


@query("stream_roundtrip", f"SELECT y, x, v AS value FROM {_V}")
def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.sources.store import read_compressed, write_compressed

    folder = shared_folder(spark)
    write_compressed(compress(vectors(spark, sf_dir), "multires"), folder, chunk=8192)
    return read_compressed(spark, folder, "vectors").df.select("y", "x", "value")


@query("binary_roundtrip", f"SELECT y, x, v AS value FROM {_V}")
def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.sources.binary import read_binary, write_binary

    grid, path = vectors(spark, sf_dir), f"{shared_folder(spark)}/vectors.bin"
    write_binary(grid, path)
    return read_binary(spark, path, "float", "vectors", grid.meta.layout, grid.meta.domain).df.select("y", "x", "value")


@query("store_region", f"SELECT y, x, v AS value FROM {_V} WHERE y >= 40 AND y < 90 AND x >= 16 AND x < 48")
def store_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.sources.store import Store

    store = Store(spark, shared_folder(spark))
    store.write([vectors(spark, sf_dir)], {"vectors": {"unit": "1"}}, {"title": "vectors"})
    return store.read("vectors", Domain.of(lat=(40, 90), lon=(16, 48))).df.select("y", "x", "value")


@query("arithmetic_roundtrip", _PREFIX + " SELECT level, nbits AS place, count(*) AS n FROM r WHERE level > 0 GROUP BY level, nbits")
def arithmetic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = compress(vectors(spark, sf_dir), "prefix")
    back = E.decode_symbols(E.encode(p, 4096), "prefix", elem("float")).filter(F.col("level") < p.depth)
    return back.groupBy("level", "place").agg(F.count("*").alias("n"))


@query(
    "huffman_bits",
    _PREFIX.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, f AS (SELECT level, nbits, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT DISTINCT level, -1, 1 FROM r), step AS (
      SELECT level, list_sort(list(n)) AS w, 0::HUGEINT AS bits FROM f GROUP BY level
      UNION ALL SELECT level, list_sort(list_append(w[3:], w[1] + w[2])), bits + w[1] + w[2] FROM step WHERE len(w) > 1)
    SELECT level, bits::BIGINT AS code_bits FROM step WHERE len(w) = 1""",
)
def huffman_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = E.huffman_codes(E.symbol_frequencies(compress(vectors(spark, sf_dir), "prefix")), "prefix", 32)
    return codes.groupBy("level").agg(F.sum(F.col("n") * F.col("code_bits")).alias("code_bits"))


@query("suffix_encodings")
def suffix_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compress(vectors(spark, sf_dir), "prefix").residuals.filter("level = 0")
    rows = rows.select(F.expr("m div 4096").alias("chunk"), F.col("m").alias("pos"), "payload", "nbits")
    return E.encode_suffixes_by(rows, tuple(suffixes.ENCODERS)).select("method", "chunk", "n", F.octet_length("data").alias("bytes"))


@query("xor_with_previous", f"SELECT event_id, xor(b, lag(b, 1, 0::BIGINT) OVER (PARTITION BY event_id // 1000 ORDER BY event_id)) AS xored FROM (SELECT event_id, event_id * 7919 % 65536 AS b FROM events)")
def xor_with_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.expr("event_id div 1000").alias("chunk"), (F.col("event_id") * 7919 % 65536).alias("payload"), F.lit(16).alias("nbits"))
    return E.xor_with_previous(rows).select(F.col("pos").alias("event_id"), "xored")


_I16 = "(SELECT event_id AS i, event_id * 7919 % 65536 AS b, (event_id % 5)::INTEGER AS front, (event_id % 7)::INTEGER AS tail, (event_id % 16)::INTEGER AS k FROM events)"


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of 16 bits, with lengths of a front and a tail."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("i"), (i * 7919 % 65536).alias("b"), (i % 5).cast("int").alias("front"), (i % 7).cast("int").alias("tail"), (i % 16).cast("int").alias("k"))


@query(
    "significant_parts",
    f"""WITH s AS (SELECT *, 16 - front - tail AS n, (b >> tail) & ((1 << (16 - front - tail)) - 1) AS p FROM {_I16})
    SELECT i, n AS significant, p AS payload, (p << (front + tail))::BIGINT AS aligned, b & (65535 >> front) AS nullified, least(n, n - length(ltrim(bin(p), '0'))) AS zeros FROM s""",
)
def significant_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, front, tail = F.col("b"), F.col("front"), F.col("tail")
    n = B.significant_bits(front, tail, 16)
    return patterns(spark, sf_dir).select(
        "i",
        n.cast("long").alias("significant"),
        B.payload(b, front, n, 16).alias("payload"),
        B.left_aligned(b, front, n, 16).alias("aligned"),
        B.nullify_front(b, front, 16).alias("nullified"),
        B.zeros_in_significant(b, front, tail, 16).cast("long").alias("zeros"),
    )


@query(
    "bit_edits",
    f"""WITH s AS (SELECT *, reverse(lpad(bin(b), 16, '0')) AS r, (1 << k) - 1 AS low, b & ~((1::BIGINT << tail) - 1) AS x, (i % (tail + 1))::INTEGER AS n FROM {_I16})
    SELECT i, xor(b, 1::BIGINT << k) AS toggled, CASE WHEN (b >> k) & 1 = 1 THEN xor(b, 1::BIGINT << k) & ~low::BIGINT ELSE xor(b, 1::BIGINT << k) | low END AS reset, 16 - length(ltrim(r, left(r, 1))) AS equal,
      x | (((i * 31) & ((1::BIGINT << n) - 1)) << (tail - n)) AS suffixed, b AS again FROM s""",
)
def bit_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, tail = F.col("b"), F.col("tail")
    rows = patterns(spark, sf_dir).withColumn("n", (F.col("i") % (tail + 1)).cast("int"))
    rows = rows.withColumn("equal", B.equal_tail(b, 16)).withColumn("x", B.keep_front(b, 16 - tail, 16))
    return rows.select(
        "i",
        B.toggle_bit(b, F.col("k"), 16).alias("toggled"),
        B.toggle_and_reset(b, F.col("k"), 16).alias("reset"),
        F.col("equal").cast("long").alias("equal"),
        B.apply_suffix(F.col("x"), tail, (F.col("i") * 31).bitwiseAND(B.shl(B.long(1), F.col("n")) - 1), F.col("n")).alias("suffixed"),
        B.restore_equal_tail(B.drop_equal_tail(b, F.col("equal"), 16), F.col("equal"), 16).alias("again"),
    )


@query("appended_cells", f"SELECT z, y, x, v AS value FROM {_E3}")
def appended_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells appended to an empty grid, by linear index and by coordinates."""
    grid = events(spark, sf_dir, "Lev_Lat_Lon")
    src = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), "value")
    half = append(hollow(grid), src.filter("i % 2 = 0"), index="i")
    rest = grid.df.filter((F.col("x") + 20 * F.col("y")) % 2 == 1)
    return append(half, rest).df.select("z", "y", "x", "value")


@query("cast_and_filled", "SELECT p_partkey // 50 AS y, p_partkey % 50 AS x, p_retailprice::FLOAT AS value, 7::INTEGER AS filled FROM part")
def cast_and_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = cast_grid(parts(spark, sf_dir, "p_retailprice", "double"), "float").df.select("y", "x", "value")
    # as many of each cell as there are parts with its key
    return single.withColumn("n", F.row_number().over(W.partitionBy("y", "x").orderBy("value"))).join(filled(parts(spark, sf_dir), 7).df.select("y", "x", F.col("value").alias("filled")).withColumn("n", F.row_number().over(W.partitionBy("y", "x").orderBy("filled"))), ["y", "x", "n"]).drop("n")


@query("wide_table_grid", f"SELECT y, x, v AS value, 'Lat_Lon' AS layout FROM {_E2} WHERE y >= 10 AND y < 60")
def wide_table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions found by their usual names, and the layout by the order of their columns."""
    from gridloom.sources.store import read_grid

    path = f"{shared_folder(spark)}/wide"
    events(spark, sf_dir, "Lat_Lon").df.select(F.col("y").alias("Latitude"), F.col("x").alias("LON"), F.col("value").alias("signal")).write.parquet(path)
    grid = read_grid(spark, path, ["signal"], Domain.of(lat=(10, 60)))[0]
    return grid.df.select("y", "x", "value", F.lit(grid.meta.layout.name).alias("layout"))


def _four(spark: SparkSession, sf_dir: str) -> Grid:
    src = table(spark, sf_dir, "events").select("event_id", "value")
    n = (src.agg(F.max("event_id")).first()[0] or 0) + 1
    layout = Layout.parse("Time_Lev_Lat_Lon")
    domain = Domain.default(layout, [-(-n // 1000), 10, 10, 10])
    return grid_of(src, "events", "double", layout, domain, coords=delinearize(layout, domain, F.col("event_id")))


@query("roundtrip_4d", "SELECT event_id // 1000 AS t, event_id // 100 % 10 AS z, event_id // 10 % 10 AS y, event_id % 10 AS x, value FROM events")
def roundtrip_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompress(compress(_four(spark, sf_dir), "multires")).df.select("t", "z", "y", "x", "value")


_NODES = f"SELECT k::INTEGER AS level, count(*) AS n FROM (SELECT DISTINCT k, y >> k AS y, x >> k AS x FROM {_E2}, (SELECT unnest(range(0, (SELECT ceil(log2(greatest(100, max(event_id) // 100 + 1)))::BIGINT FROM events))) AS k)) GROUP BY k"


@query("stored_schemes", f"WITH n AS ({_NODES}), s AS (SELECT unnest(['prefix', 'multires', 'xor', 'quantized_prefix', 'trimmed']) AS scheme) SELECT scheme, level, n, (SELECT count(*) FROM events) AS within FROM s, n")
def stored_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records by level of every scheme, and how many cells come back within the bound (0 for lossless ones)."""
    from gridloom.sources.store import load_pyramid, restore, save_pyramid

    grid, out = events(spark, sf_dir, "Lat_Lon"), []
    rules = ErrorRules().general("abs", 0.5)
    made = {s: lambda s=s: compress(grid, s) for s in ("prefix", "multires", "xor")} | {"quantized_prefix": lambda: L.compress_quantized_prefix(grid, rules), "trimmed": lambda: L.compress_trimmed(grid, rules)}
    for scheme, make in made.items():
        folder = f"{shared_folder(spark)}/{scheme}"
        save_pyramid(make(), folder)
        pyramid, form = load_pyramid(spark, folder, "events")
        within = Q.errors(Q.paired(grid, restore(pyramid, form))).agg(F.count_if(F.col("abs_err") <= (0.5 if scheme in ("quantized_prefix", "trimmed") else 0.0)).alias("within"))
        counts = pyramid.residuals.groupBy("level").agg(F.count("*").alias("n"))
        out.append(counts.join(F.broadcast(within)).select(F.lit(scheme).alias("scheme"), "level", "n", "within"))  # one row
    return reduce(DataFrame.unionByName, out)


@query("streamed_slices", "SELECT event_id // 1000 AS t, count(*) AS n FROM events GROUP BY ALL")
def streamed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time slices that arrive as files: the finest level's records of each slice, as the stream has written them."""
    from gridloom.streaming.slices import compress_stream

    folder = shared_folder(spark)
    grid = _four(spark, sf_dir)
    grid.df.repartition("t").write.parquet(f"{folder}/in")
    layout = Layout.parse("Lev_Lat_Lon")
    meta = grid.meta.but(layout=layout, domain=Domain.default(layout, [10, 10, 10]))
    stream = spark.readStream.schema(grid.df.schema).parquet(f"{folder}/in")
    compress_stream(stream, meta, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").filter("level = 0").groupBy("t").agg(F.sum("n").alias("n"))


# --- error bounds --------------------------------------------------------------------------------------------------

RULES = ErrorRules().general("abs", 1.0).general("rel", 0.01).region("abs", 0.5, Domain.of(lat=(0, 100), lon=(0, 32))).region("rel", 0.005, Domain.of(lat=(50, 200)))


@query(
    "restricting_errors",
    f"SELECT y, x, CASE WHEN y < 100 AND x < 32 THEN 0.5 ELSE 1.0 END::DOUBLE AS abs_eps, CASE WHEN y >= 50 AND y < 200 THEN 0.005 ELSE 0.01 END::DOUBLE AS rel_eps FROM {_V}",
)
def restricting_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RULES.restricting(vectors(spark, sf_dir).df).select("y", "x", "abs_eps", "rel_eps")


def _coarsening(levels: int) -> str:
    """Adaptive coarsening of part sizes (integers: means are truncated) under an absolute bound, level by level."""
    out = f"WITH s0 AS (SELECT y, x, v, 0.0::DOUBLE AS err FROM {_P2})"
    for k in range(levels):
        places = f"(SELECT count(*) FROM (SELECT DISTINCT y // {1 << k} AS y, x // {1 << k} AS x FROM {_P2}) q WHERE q.y // 2 = f.y AND q.x // 2 = f.x)"
        out += f""", f{k} AS (SELECT y // 2 AS y, x // 2 AS x, trunc(avg(v::DOUBLE))::INTEGER AS c, count(*) AS n FROM s{k} GROUP BY ALL),
        d{k} AS (SELECT s.y, s.x, s.v, s.err, f.c, f.n, {places} AS places, abs(s.v - f.c)::DOUBLE + s.err AS dev FROM s{k} s JOIN f{k} f ON s.y // 2 = f.y AND s.x // 2 = f.x),
        g{k} AS (SELECT y // 2 AS y, x // 2 AS x, c, max(dev) AS err, bool_and(dev <= 8.0 AND n = places) AS ok FROM d{k} GROUP BY ALL),
        e{k} AS (SELECT {k} AS level, d.y, d.x, d.v AS value, d.err FROM d{k} d JOIN g{k} g ON d.y // 2 = g.y AND d.x // 2 = g.x WHERE NOT g.ok),
        s{k + 1} AS (SELECT y, x, c AS v, err FROM g{k} WHERE ok)"""
    tail = " UNION ALL ".join([f"SELECT * FROM e{k}" for k in range(levels)] + [f"SELECT {levels} AS level, y, x, v AS value, err FROM s{levels}"])
    return out + f" SELECT level, {_morton('x', 'y')} AS m, value, err FROM ({tail})"


@query("adaptive_coarsen_level1", _coarsening(1))
def adaptive_coarsen_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.adaptive_coarsening(parts(spark, sf_dir), ErrorRules().general("abs", 8.0), skip_missing=False, depth=1).select("level", "m", "value", "err")


@query("adaptive_coarsen_levels", _coarsening(3))
def adaptive_coarsen_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.adaptive_coarsening(parts(spark, sf_dir), ErrorRules().general("abs", 8.0), skip_missing=False, depth=3).select("level", "m", "value", "err")


def _violations(initial: Grid, restored: Grid, abs_bound: float | None = None, rel_bound: float | None = None) -> DataFrame:
    q = Q.quality(Q.paired(initial, restored), abs_bound, rel_bound)
    return q.select("n", (F.col("abs_violations") + F.col("rel_violations")).alias("violations"))


@query("adaptive_coarsen_bound", "SELECT count(*) AS n, 0::BIGINT AS violations FROM part")
def adaptive_coarsen_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = parts(spark, sf_dir)
    return _violations(grid, L.expand_elements(L.adaptive_coarsening(grid, ErrorRules().general("abs", 8.0)), grid.meta), 8.0)


@query("quantized_prefix_bound", f"SELECT count(*) AS n, 0::BIGINT AS violations FROM {_V}")
def quantized_prefix_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = vectors(spark, sf_dir)
    return _violations(grid, L.decompress_quantized_prefix(L.compress_quantized_prefix(grid, ErrorRules().general("abs", 0.01).general("rel", 0.05))), 0.01, 0.05)


@query("trimmed_residuals_bound", f"SELECT count(*) AS n, 0::BIGINT AS violations FROM {_E2}")
def trimmed_residuals_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = events(spark, sf_dir, "Lat_Lon")
    return _violations(grid, L.decompress_trimmed(L.compress_trimmed(grid, ErrorRules().general("abs", 0.5))), 0.5)


# --- neighbours ----------------------------------------------------------------------------------------------------

_LORENZO = f"""WITH g AS (SELECT y, x, v FROM {_E2}),
    p AS (SELECT g.y, g.x, g.v, a.v + b.v - c.v AS p FROM g JOIN g a ON a.y = g.y - 1 AND a.x = g.x JOIN g b ON b.y = g.y AND b.x = g.x - 1 JOIN g c ON c.y = g.y - 1 AND c.x = g.x - 1)"""


@query("lorenzo_2d", _LORENZO + " SELECT y, x, p AS prediction, v - p AS residual, CASE WHEN v = 0 THEN v - p = 0 ELSE abs((v - p) / v) <= 0.1 END AS zero FROM p")
def lorenzo_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.lorenzo(events(spark, sf_dir, "Lat_Lon"), 0.1).select("y", "x", "prediction", "residual", "zero")


@query(
    "lorenzo_feedback",
    f"""WITH RECURSIVE g AS (SELECT y, list(v ORDER BY x) AS vs FROM {_E2} GROUP BY y),
    walk AS (SELECT y, vs, vs AS r FROM g WHERE y = 0
      UNION ALL SELECT g.y, g.vs, list_reduce(list_transform(range(2, len(g.vs) + 1), lambda i: [i::DOUBLE]), lambda acc, j: list_append(acc, CASE
        WHEN abs((walk.r[j[1]::BIGINT] + acc[-1]) - walk.r[j[1]::BIGINT - 1] - g.vs[j[1]::BIGINT]) <= 0.1 * abs(g.vs[j[1]::BIGINT]) THEN (walk.r[j[1]::BIGINT] + acc[-1]) - walk.r[j[1]::BIGINT - 1]
        ELSE g.vs[j[1]::BIGINT] END), [g.vs[1]]) FROM walk JOIN g ON g.y = walk.y + 1),
    c AS (SELECT y, unnest(range(len(vs))) AS x, unnest(vs) AS value, unnest(r) AS restored FROM walk)
    SELECT c.y, c.x, c.value, c.restored, coalesce(abs((a.restored + b.restored) - d.restored - c.value) <= 0.1 * abs(c.value), false) AS zero FROM c
      LEFT JOIN c a ON a.y = c.y - 1 AND a.x = c.x LEFT JOIN c b ON b.y = c.y AND b.x = c.x - 1 LEFT JOIN c d ON d.y = c.y - 1 AND d.x = c.x - 1""",
)
def lorenzo_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.lorenzo_feedback(events(spark, sf_dir, "Lat_Lon"), 0.1).select("y", "x", "value", "restored", "zero")


@query(
    "face_neighbors",
    f"""WITH g AS (SELECT y, x, v FROM {_V}), j AS (SELECT g.y, g.x, a.v AS f0, b.v AS f1, c.v AS f2, d.v AS f3 FROM g
      LEFT JOIN g a ON a.y = g.y AND a.x = g.x - 1 LEFT JOIN g b ON b.y = g.y AND b.x = g.x + 1
      LEFT JOIN g c ON c.y = g.y - 1 AND c.x = g.x LEFT JOIN g d ON d.y = g.y + 1 AND d.x = g.x)
    SELECT *, ((f0 IS NOT NULL)::INTEGER + (f1 IS NOT NULL)::INTEGER + (f2 IS NOT NULL)::INTEGER + (f3 IS NOT NULL)::INTEGER)::INTEGER AS faces,
      (CASE WHEN x % 2 = 1 THEN f0 IS NOT NULL ELSE f1 IS NOT NULL END::INTEGER + CASE WHEN y % 2 = 1 THEN f2 IS NOT NULL ELSE f3 IS NOT NULL END::INTEGER)::INTEGER AS in_family FROM j""",
)
def face_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.face_neighbours(vectors(spark, sf_dir)).select("y", "x", "f0", "f1", "f2", "f3", "faces", "in_family")


@query(
    "idw_predict",
    f"""WITH g AS (SELECT y, x, v FROM {_E2}), s AS (SELECT y // 2 AS y, x // 2 AS x, v FROM g WHERE y % 2 = 0 AND x % 2 = 0),
    w AS (SELECT g.y, g.x, s.v, pow((g.x % 2 - 2 * (s.x - g.x // 2)) ** 2 + (g.y % 2 - 2 * (s.y - g.y // 2)) ** 2, 8) AS d
      FROM g JOIN s ON (s.y = g.y // 2 AND abs(s.x - g.x // 2) <= 1) OR (s.x = g.x // 2 AND abs(s.y - g.y // 2) = 1))
    SELECT y, x, round(CASE WHEN min(d) = 0 THEN min(CASE WHEN d = 0 THEN v END) ELSE sum(CASE WHEN d > 0 THEN v / d END) / sum(CASE WHEN d > 0 THEN 1 / d END) END, 6) AS prediction FROM w GROUP BY y, x""",
)
def idw_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.idw_prediction(events(spark, sf_dir, "Lat_Lon")).select("y", "x", F.round("prediction", 6).alias("prediction"))


_FACES3 = f"""WITH g AS (SELECT z, y, x, v FROM {_E3}), c AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM g GROUP BY ALL),
    n AS (SELECT c.z, c.y, c.x, c.v, coalesce(a.v, b.v, c.v) AS f0, coalesce(b.v, a.v, c.v) AS f1, coalesce(d.v, e.v, c.v) AS f2, coalesce(e.v, d.v, c.v) AS f3, coalesce(h.v, k.v, c.v) AS f4, coalesce(k.v, h.v, c.v) AS f5 FROM c
      LEFT JOIN c a ON a.z = c.z AND a.y = c.y AND a.x = c.x - 1 LEFT JOIN c b ON b.z = c.z AND b.y = c.y AND b.x = c.x + 1
      LEFT JOIN c d ON d.z = c.z AND d.y = c.y - 1 AND d.x = c.x LEFT JOIN c e ON e.z = c.z AND e.y = c.y + 1 AND e.x = c.x
      LEFT JOIN c h ON h.z = c.z - 1 AND h.y = c.y AND h.x = c.x LEFT JOIN c k ON k.z = c.z + 1 AND k.y = c.y AND k.x = c.x),
    m AS (SELECT g.z, g.y, g.x, n.v, CASE WHEN g.x % 2 = 1 THEN f1 ELSE f0 END AS nx, CASE WHEN g.x % 2 = 1 THEN f0 ELSE f1 END AS fx,
      CASE WHEN g.y % 2 = 1 THEN f3 ELSE f2 END AS ny, CASE WHEN g.y % 2 = 1 THEN f2 ELSE f3 END AS fy, CASE WHEN g.z % 2 = 1 THEN f5 ELSE f4 END AS nz, CASE WHEN g.z % 2 = 1 THEN f4 ELSE f5 END AS fz
      FROM g JOIN n ON g.z // 2 = n.z AND g.y // 2 = n.y AND g.x // 2 = n.x)"""


@query("hex_weighted_predict", _FACES3 + " SELECT z, y, x, round(v / 5 + (nx + ny + nz) / 6 + (fx + fy + fz) / 10, 6) AS prediction FROM m")
def hex_weighted_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.face_prediction(events(spark, sf_dir, "Lev_Lat_Lon"), A.mean(elem("double")), N.HEX_WEIGHTS)
    return rows.select("z", "y", "x", F.round("prediction", 6).alias("prediction"))


@query("hex_near_predict", _FACES3 + " SELECT z, y, x, round((v + nx + ny + nz) / 4, 9) AS prediction FROM m")
def hex_near_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.face_prediction(events(spark, sf_dir, "Lev_Lat_Lon"), A.mean(elem("double")))
    return rows.select("z", "y", "x", F.round("prediction", 9).alias("prediction"))


@query("coded_by_faces", f"SELECT y, x, v AS value FROM {_E2}")
def coded_by_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.decompress_predicted(P.compress_predicted(events(spark, sf_dir, "Lat_Lon"), "near")).df.select("y", "x", "value")


@query("coded_by_distance", _NODES)
def coded_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each level that inverse distances predict."""
    return P.compress_predicted(events(spark, sf_dir, "Lat_Lon"), "distance").differences.groupBy("level").agg(F.count("*").alias("n"))


def _pattern(x: str) -> str:
    return f"(CAST(CAST(CAST({x} AS FLOAT) AS BIT) AS INTEGER)::BIGINT & 4294967295)"


@query(
    "linear_reconstruction",
    f"""WITH g AS (SELECT y, x, v::FLOAT AS v FROM {_V}), j AS (SELECT g.y, g.x, g.v, a.v AS f0, b.v AS f1, c.v AS f2, d.v AS f3 FROM g
      LEFT JOIN g a ON a.y = g.y AND a.x = g.x - 1 LEFT JOIN g b ON b.y = g.y AND b.x = g.x + 1
      LEFT JOIN g c ON c.y = g.y - 1 AND c.x = g.x LEFT JOIN g d ON d.y = g.y + 1 AND d.x = g.x),
    k AS (SELECT y // 2 AS y, x // 2 AS x, row_number() OVER (PARTITION BY y // 2, x // 2 ORDER BY y % 2, x % 2) - 1 AS place, v,
      CASE WHEN x % 2 = 1 THEN f1 ELSE f0 END AS ox, CASE WHEN x % 2 = 1 THEN f0 ELSE f1 END AS kx, CASE WHEN y % 2 = 1 THEN f3 ELSE f2 END AS oy, CASE WHEN y % 2 = 1 THEN f2 ELSE f3 END AS ky FROM j),
    s AS (SELECT y, x, v, coalesce(ox::DOUBLE, 0) + coalesce(oy::DOUBLE, 0) AS s, (ox IS NOT NULL)::INTEGER + (oy IS NOT NULL)::INTEGER AS o, (kx IS NOT NULL)::INTEGER + (ky IS NOT NULL)::INTEGER AS k FROM k),
    f AS (SELECT y, x, count(*) AS n, CASE WHEN count(*) = 1 THEN min(v) ELSE (max(v)::DOUBLE / 2 + min(v)::DOUBLE / 2)::FLOAT END AS middle, (sum(v::DOUBLE) / count(*))::FLOAT AS mean FROM k GROUP BY y, x),
    c AS (SELECT y, x, place, v AS p FROM k UNION ALL SELECT y, x, n, middle FROM f UNION ALL SELECT y, x, n + 1, mean FROM f),
    r AS (SELECT c.y, c.x, c.place, c.p, s.v, CASE WHEN o = 0 THEN p ELSE ((s.s + p::DOUBLE * k) / (k + o))::FLOAT END AS b FROM c JOIN s ON c.y = s.y AND c.x = s.x),
    z AS (SELECT y, x, place, any_value(p) AS predictor, sum({_lz(f"abs({_pattern('v')} - {_pattern('b')})")})::BIGINT AS zeros FROM r GROUP BY y, x, place)
    SELECT y, x, place::INTEGER AS place, predictor, zeros FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY zeros DESC, place) AS best FROM z) WHERE best = 1""",
)
def linear_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.linear_reconstruction(vectors(spark, sf_dir)).select("y", "x", "place", "predictor", "zeros")


@query(
    "scanline_window",
    f"""WITH g AS (SELECT DISTINCT y // 2 AS y, x // 2 AS x FROM {_E2}), i AS (SELECT {_morton('x', 'y')} AS m, row_number() OVER (ORDER BY {_morton('x', 'y')}) - 1 AS i, count(*) OVER () AS total FROM g)
    SELECT m, i, greatest(i - 26, 0)::BIGINT AS first, (least(greatest(i - 26, 0) + 53, total) - 1)::BIGINT AS last, (least(greatest(i - 26, 0) + 53, total) - greatest(i - 26, 0))::INTEGER AS n FROM i""",
)
def scanline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.scanline(N.extremes(events(spark, sf_dir, "Lat_Lon")), bucket=128)
    return rows.select("m", "i", F.array_min(F.transform("line", lambda p: p["i"])).alias("first"), F.array_max(F.transform("line", lambda p: p["i"])).alias("last"), F.size("line").alias("n"))


@query(
    "scanline_predict",
    f"""WITH g AS (SELECT y, x, v FROM {_E2}), f AS (SELECT y // 2 AS fy, x // 2 AS fx, list({{'v': v, 'y': y, 'x': x}} ORDER BY v DESC, y % 2, x % 2)[1] AS high, list({{'v': v, 'y': y, 'x': x}} ORDER BY v, y % 2, x % 2)[1] AS low FROM g GROUP BY ALL),
    i AS (SELECT *, row_number() OVER (ORDER BY {_morton('fx', 'fy')}) - 1 AS i FROM f),
    p AS (SELECT i, high AS at FROM i UNION ALL SELECT i, low FROM i WHERE low.v <> high.v),
    n AS (SELECT g.y, g.x, g.v, p.at.v AS pv, ((p.at.y - g.y) ** 2 + (p.at.x - g.x) ** 2)::DOUBLE AS d FROM g JOIN i ON i.fy = g.y // 2 AND i.fx = g.x // 2 JOIN p ON p.i >= greatest(i.i - 26, 0) AND p.i < greatest(i.i - 26, 0) + 53),
    r AS (SELECT y, x, any_value(v) AS value, list_sort(list(d))[7] AS radius, min(CASE WHEN d = 0 THEN pv END) AS hit FROM n GROUP BY y, x),
    u AS (SELECT y, x, sum(CASE WHEN d > 0 AND (radius IS NULL OR d < radius) THEN pow(d, -8) * pv END) / sum(CASE WHEN d > 0 AND (radius IS NULL OR d < radius) THEN pow(d, -8) END) AS p FROM n JOIN r USING (y, x) GROUP BY y, x)
    SELECT y, x, value, round(coalesce(hit, p), 6) AS prediction FROM r JOIN u USING (y, x)""",
)
def scanline_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.scanline_prediction(events(spark, sf_dir, "Lat_Lon")).select("y", "x", "value", F.round("prediction", 6).alias("prediction"))


_BINS = "CASE WHEN abs(v - p) <= 0.5 THEN 0 WHEN floor(abs(v - p) / 1.0 + 0.5) < 2045 THEN floor(abs(v - p) / 1.0 + 0.5) + CASE WHEN v - p < 0 THEN 2045 ELSE 0 END ELSE 2045 END::INTEGER"


@query("residual_quantize", _LORENZO + f" SELECT y, x, {_BINS} AS bin FROM p")
def residual_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quantize_residuals(N.lorenzo(events(spark, sf_dir, "Lat_Lon")), 0.5).select("y", "x", "bin")


@query("residual_histogram", _LORENZO + " SELECT least(greatest(ceil(abs(v - p) / 10.0), 1), 11)::INTEGER AS bin, count(*) AS n FROM p GROUP BY bin")
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.residual_histogram(N.lorenzo(events(spark, sf_dir, "Lat_Lon")), 10.0)


@query("remaining_budget", _LORENZO + " SELECT y // 2 AS y, x // 2 AS x, round(min(CASE WHEN abs(v - p) <= 50 THEN 50 - abs(v - p) END), 6) AS budget FROM p GROUP BY y // 2, x // 2")
def remaining_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.lorenzo(events(spark, sf_dir, "Lat_Lon")).select(F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), "residual", F.lit(50.0).alias("budget"))
    return L.remaining_budget(rows, ("y", "x")).select("y", "x", F.round("budget", 6).alias("budget"))


# --- quality and meshes --------------------------------------------------------------------------------------------

def _blurred(grid: Grid) -> Grid:
    """Every cell as its family's mean."""
    coarse = coarsen(grid, A.mean(grid.meta.elem)).df.withColumnRenamed("value", "mean")
    return Grid(N.with_parent(grid, coarse).withColumn("value", F.col("mean")).drop("mean"), grid.meta)


_BLURRED = f"WITH g AS (SELECT y, x, v FROM {_P2}), c AS (SELECT y // 2 AS y, x // 2 AS x, trunc(avg(v::DOUBLE))::INTEGER AS c FROM g GROUP BY ALL), e AS (SELECT g.y * 50 + g.x AS i, v, abs(v - c) AS d FROM g JOIN c ON g.y // 2 = c.y AND g.x // 2 = c.x)"


@query(
    "quality_metrics",
    _BLURRED
    + """ SELECT count(*) AS n, max(d)::DOUBLE AS max_abs_err, round(max(CASE WHEN v = 0 THEN 0 ELSE d / abs(v) END), 9) AS max_rel_err, count(*) FILTER (d > 10) AS abs_violations,
    round(sqrt(avg(d * d)), 9) AS rmse, round(20 * log10(max(v) - min(v)) - 10 * log10(avg(d * d)), 9) AS psnr FROM e""",
)
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = parts(spark, sf_dir)
    q = Q.quality(Q.paired(grid, _blurred(grid)), abs_bound=10)
    return q.select("n", "max_abs_err", F.round("max_rel_err", 9).alias("max_rel_err"), "abs_violations", F.round("rmse", 9).alias("rmse"), F.round("psnr", 9).alias("psnr"))


@query("violations", _BLURRED + " SELECT i, d::DOUBLE AS abs_err FROM e WHERE d > 10")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = parts(spark, sf_dir)
    return Q.errors(Q.paired(grid, _blurred(grid))).filter("abs_err > 10").select("i", "abs_err")


@query("equality", "SELECT true AS equal, 0::BIGINT AS mismatches")
def equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = parts(spark, sf_dir)
    return Q.equality(Q.paired(grid, decompress(compress(grid, "multires")))).select("equal", "mismatches")


@query("linear_values", "SELECT event_id AS i, value FROM events")
def linear_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear(events(spark, sf_dir, "Lev_Lat_Lon")).select("i", "value")


_MESH = """WITH n AS (SELECT max(event_id) // 100 + 1 AS rows FROM events), d AS (SELECT rows, ceil(log2(greatest(rows, 100)))::INTEGER AS depth FROM n),
    k AS (SELECT unnest(range(0, depth)) AS k, rows FROM d),
    c AS (SELECT k, (rows + (1 << k) - 1) // (1 << k) AS iy, (100 + (1 << k) - 1) // (1 << k) AS ix, 2 * ((rows + (2 << k) - 1) // (2 << k)) AS wy, 2 * ((100 + (2 << k) - 1) // (2 << k)) AS wx FROM k),
    e AS (SELECT k AS level, (wy * wx - iy * ix + CASE WHEN k = 0 THEN iy * ix ELSE 0 END)::BIGINT AS n FROM c) SELECT level::INTEGER AS level, n FROM e WHERE n > 0"""


@query("mesh_elements", _MESH)
def mesh_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.embedded_elements(events(spark, sf_dir, "Lat_Lon")).groupBy("level").agg(F.count("*").alias("n"))


@query("mesh_roundtrip", _MESH)
def mesh_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = events(spark, sf_dir, "Lat_Lon")
    elements = M.embedded_elements(grid).select("var", "m", "level")
    packed = M.pack_bits(M.refinement_bits(elements, 2, grid.meta.depth))
    back = M.decode_mesh(M.unpack_bits(packed), 2, grid.meta.depth)
    return back.join(elements, ["var", "m", "level"], "left_semi").groupBy("level").agg(F.count("*").alias("n"))
