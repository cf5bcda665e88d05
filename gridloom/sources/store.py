"""Grids in Parquet: cells by variable, their descriptions and attributes beside them, and compressed variables.

A store is a folder with ``cells`` (one folder per variable, sorted along the Morton curve in contiguous ranges, so that
range filters on coordinates skip row groups), ``variables`` and ``attributes``. Wide tables with coordinate columns of
common names can be read as grids too.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.coords import in_domain, morton_of
from gridloom.operators.entropy import CHUNK, decode, encode
from gridloom.operators.grid import Grid, grid_of, slice_grid
from gridloom.operators.pyramid import Pyramid, grid_from_cells
from gridloom.plans.domain import AXES, COORDS, DIMENSIONS, Domain, GridMeta, Layout
from gridloom.plans.types import ELEMS, elem

#: Names that dimensions go by.
ALIASES = {
    "Lon": ("lon", "longitude", "x"),
    "Lat": ("lat", "latitude", "y"),
    "Lev": ("lev", "level", "height", "elevation", "z"),
    "Time": ("time", "t"),
}

_META = "var string, elem string, layout string, starts array<long>, lengths array<long>, missing string, scale double, offset double, context int"
_ATTR = "var string, name string, type string, value string"


def resolve_dimensions(columns: Iterable[str], hints: Mapping[str, str] | None = None) -> dict[str, str]:
    """Column of each dimension that is found: by hint first, then by its usual names, in any case."""
    columns, hints = [*columns], dict(hints or {})
    lower = {c.lower(): c for c in columns}
    out = {}
    for dim in DIMENSIONS:
        if dim in hints:
            if hints[dim] not in columns:
                raise ValueError(f"no column {hints[dim]} for {dim}")
            out[dim] = hints[dim]
            continue
        found = next((lower[a] for a in ALIASES[dim] if a in lower and lower[a] not in hints.values()), None)
        if found:
            out[dim] = found
    return out


def infer_layout(columns: Iterable[str], dims: Mapping[str, str], lengths: Mapping[str, int] | None = None) -> Layout:
    """The dimensions in order of their columns; those of length 1 are left out if lengths are given (all are kept if none is longer)."""
    order = [d for c in columns for d, name in dims.items() if name == c]
    kept = [d for d in order if not lengths or lengths[d] > 1] or order
    return Layout(tuple(kept))


def read_grid(spark: SparkSession, path: str, names: Iterable[str], region: Domain | None = None, hints: Mapping[str, str] | None = None, layout: str | Layout | None = None, **meta) -> list[Grid]:
    """Variables of a wide Parquet table, one grid per named column. The region's ranges and the columns reach the scan."""
    df = spark.read.parquet(path)
    dims = resolve_dimensions(df.columns, hints)
    if not dims:
        raise ValueError(f"no coordinate columns among {', '.join(df.columns)}")
    bounds = df.agg(*[F.min(c).alias(f"{d}_min") for d, c in dims.items()], *[F.max(c).alias(f"{d}_max") for d, c in dims.items()]).first()
    domain = Domain({d: (int(bounds[f"{d}_min"] or 0), int(bounds[f"{d}_max"] if bounds[f"{d}_max"] is not None else -1) + 1) for d in dims})
    layout = Layout.parse(layout) if layout else infer_layout(df.columns, dims, {d: domain.length(d) for d in dims})
    if region:
        domain = Domain({d: region.interval(d) if d in region.intervals else domain.interval(d) for d in dims})
        for d, c in dims.items():
            s, e = domain.interval(d)
            df = df.filter((F.col(c) >= s) & (F.col(c) < e))
    kinds = {e.spark: e.name for e in reversed(ELEMS.values()) if not e.name.startswith("u") and e.name != "char"}
    types = dict(df.dtypes)
    coords = {AXES[d]: F.col(c) for d, c in dims.items()}
    return [grid_of(df, n, kinds[types[n]], layout, Domain({d: domain.interval(d) for d in layout.dims}), n, {a: c for a, c in coords.items() if a in layout.axes}, **meta) for n in names]


@dataclass
class Store:
    """A folder of variables."""

    spark: SparkSession
    path: str
    stash: list[tuple[str, list[Domain]]] = field(default_factory=list)

    # --- writing ---------------------------------------------------------------------------------------------------

    def write(self, grids: Iterable[Grid], attributes: Mapping[str, Mapping[str, object]] | None = None, general: Mapping[str, object] | None = None, parts: int | None = None) -> None:
        """Adds variables with their attributes, and general attributes of the store."""
        metas = []
        for g in grids:
            cells = g.df.withColumn("_m", morton_of(g.axes, g.meta.domain.starts(g.meta.layout)))
            cells = cells.repartitionByRange(parts, "_m") if parts else cells.repartitionByRange("_m")
            cells.sortWithinPartitions("_m").drop("_m", "var").write.mode("overwrite").parquet(f"{self.path}/cells/{g.meta.name}")
            m = g.meta
            metas.append((m.name, m.elem.name, m.layout.name, [*m.domain.starts(m.layout)], [*m.lengths], repr(m.missing), float(m.scale), float(m.offset), m.context))
        self.spark.createDataFrame(metas, _META).coalesce(1).write.mode("append").parquet(f"{self.path}/variables")
        rows = [(v, n, type(x).__name__, repr(x)) for v, named in (attributes or {}).items() for n, x in named.items()]
        rows += [(None, n, type(x).__name__, repr(x)) for n, x in (general or {}).items()]
        self.spark.createDataFrame(rows, _ATTR).coalesce(1).write.mode("append").parquet(f"{self.path}/attributes")

    # --- descriptions ----------------------------------------------------------------------------------------------

    def meta(self, name: str) -> GridMeta:
        r = self.spark.read.parquet(f"{self.path}/variables").filter(F.col("var") == name).first()
        if r is None:
            raise ValueError(f"{self.path} has no variable {name}")
        layout, kind = Layout.parse(r["layout"]), elem(r["elem"])
        domain = Domain({d: (s, s + n) for d, s, n in zip(layout.dims, r["starts"], r["lengths"], strict=True)})
        missing = float(r["missing"]) if kind.is_float else int(r["missing"])
        return GridMeta(name, kind, layout, domain, missing, r["scale"], r["offset"], context=r["context"])

    def variables(self) -> list[str]:
        return sorted(r["var"] for r in self.spark.read.parquet(f"{self.path}/variables").select("var").distinct().collect())

    def attributes(self, name: str | None = None) -> dict[str, object]:
        """A variable's attributes, or the general ones."""
        import ast

        rows = self.spark.read.parquet(f"{self.path}/attributes")
        rows = rows.filter(F.col("var").isNull() if name is None else F.col("var") == name)
        return {r["name"]: ast.literal_eval(r["value"]) for r in rows.collect()}

    # --- reading ---------------------------------------------------------------------------------------------------

    def read(self, name: str, region: Domain | None = None, pad: bool = False) -> Grid:
        """A variable or a region of it."""
        meta = self.meta(name)
        cells = self.spark.read.parquet(f"{self.path}/cells/{name}").select(F.lit(name).alias("var"), *COORDS, "value")
        grid = Grid(cells, meta)
        return grid if region is None else slice_grid(grid, region, pad)

    def stash_for_reading(self, name: str, *regions: Domain) -> None:
        """Notes regions (none: all) for one later ``read_stashed``."""
        self.stash.append((name, [*regions]))

    def read_stashed(self) -> list[Grid]:
        """One grid per noted variable, of the union of its regions: one scan with the ranges joined by OR."""
        out = []
        for name, regions in self.stash:
            grid = self.read(name)
            if regions:
                any_of = None
                for r in regions:
                    full = Domain({d: r.interval(d) if d in r.intervals else grid.meta.domain.interval(d) for d in grid.meta.layout.dims})
                    inside = in_domain(grid.meta.layout, full)
                    any_of = inside if any_of is None else any_of | inside
                grid = Grid(grid.df.filter(any_of), grid.meta)
            out.append(grid)
        self.stash.clear()
        return out


# --- compressed variables ------------------------------------------------------------------------------------------

def write_compressed(pyramid: Pyramid, path: str, chunk: int = CHUNK) -> None:
    """Records and description of a losslessly compressed variable; chunks of a level are coded in parallel."""
    meta = pyramid.meta
    encode(pyramid, chunk).write.mode("overwrite").partitionBy("level").parquet(f"{path}/{meta.name}/stream")
    row = (meta.name, meta.elem.name, meta.layout.name, [*meta.domain.starts(meta.layout)], [*meta.lengths], repr(meta.missing), pyramid.scheme, pyramid.depth)
    schema = "var string, elem string, layout string, starts array<long>, lengths array<long>, missing string, scheme string, depth int"
    pyramid.root.sparkSession.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{meta.name}/description")


def compressed_variables(spark: SparkSession, path: str, names: Iterable[str]) -> DataFrame:
    """Descriptions of compressed variables, without their records."""
    return spark.read.parquet(*[f"{path}/{n}/description" for n in names])


def read_compressed(spark: SparkSession, path: str, name: str) -> Grid:
    """Restores a variable; its description says by which scheme."""
    r = compressed_variables(spark, path, [name]).first()
    layout, kind = Layout.parse(r["layout"]), elem(r["elem"])
    if r["scheme"] not in ("prefix", "multires"):
        raise ValueError(f"{name} holds an unknown scheme: {r['scheme']}")
    domain = Domain({d: (s, s + n) for d, s, n in zip(layout.dims, r["starts"], r["lengths"], strict=True)})
    meta = GridMeta(name, kind, layout, domain, float(r["missing"]) if kind.is_float else int(r["missing"]))
    stream = spark.read.parquet(f"{path}/{name}/stream").select("var", "level", "chunk", "first", "n", "alphabet", "codes", "data")
    return grid_from_cells(decode(stream, r["scheme"], meta, r["depth"]).select("var", "m", "bits"), meta)


# --- pyramids of any scheme ----------------------------------------------------------------------------------------

_SAVED = "var string, elem string, layout string, starts array<long>, lengths array<long>, missing string, scheme string, depth int, form string, record binary"


def save_pyramid(pyramid: Pyramid, path: str, form: str = "grid") -> None:
    """Stores what any scheme gives, lossless or not: residuals in a folder per level, what stands at the top, and a description.

    ``form`` says what the cells are: those of a ``grid``, of a grid on its ``embedded`` tree, or of a caller's ``forest``.
    """
    from gridloom.operators.mesh import root_record

    if form not in ("grid", "embedded", "forest"):
        raise ValueError(f"no such form: {form}")
    meta, at = pyramid.meta, f"{path}/{pyramid.meta.name}"
    pyramid.residuals.write.mode("overwrite").partitionBy("level").parquet(f"{at}/residuals")
    pyramid.root.write.mode("overwrite").parquet(f"{at}/root")
    row = (meta.name, meta.elem.name, meta.layout.name, [*meta.domain.starts(meta.layout)], [*meta.lengths], repr(meta.missing), pyramid.scheme, pyramid.depth, form, bytearray(root_record(meta)))
    pyramid.root.sparkSession.createDataFrame([row], _SAVED).coalesce(1).write.mode("overwrite").parquet(f"{at}/pyramid")


def load_pyramid(spark: SparkSession, path: str, name: str) -> tuple[Pyramid, str]:
    """(the stored pyramid, its form). A filter on ``level`` reads that level's folder alone."""
    from gridloom.operators.mesh import read_root_record

    at = f"{path}/{name}"
    r = spark.read.parquet(f"{at}/pyramid").first()
    layout, kind = Layout.parse(r["layout"]), elem(r["elem"])
    domain = Domain({d: (s, s + n) for d, s, n in zip(layout.dims, r["starts"], r["lengths"], strict=True)})
    meta = GridMeta(name, kind, layout, domain, float(r["missing"]) if kind.is_float else int(r["missing"]))
    if read_root_record(bytes(r["record"]))[2] != Domain({d: domain.interval(d) for d in DIMENSIONS}):
        raise ValueError(f"{at}: the root record names another domain")
    residuals = spark.read.parquet(f"{at}/residuals").withColumn("level", F.col("level").cast("int"))
    return Pyramid(r["scheme"], meta, r["depth"], residuals, spark.read.parquet(f"{at}/root")), r["form"]


def restore(pyramid: Pyramid, form: str = "grid") -> Grid | DataFrame:
    """The grid (or the forest's elements) of a pyramid of any scheme and form."""
    from gridloom.operators import lossy, mesh
    from gridloom.operators.pyramid import decompress

    if form == "forest":
        return mesh.decompress_forest(pyramid)
    if form == "embedded":
        return mesh.decompress_embedded(pyramid)
    return {"quantized_prefix": lossy.decompress_quantized_prefix, "trimmed": lossy.decompress_trimmed}.get(pyramid.scheme, decompress)(pyramid)
