"""Symbol statistics and level records: aggregates and windows, with the sequential coder in workers per chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import arithmetic, suffixes
from gridloom.functions.bits import long
from gridloom.functions.coords import delinearize, linearize, morton_decode, morton_encode
from gridloom.functions.packing import pack_fields, unpack_fields
from gridloom.functions.symbols import BOUNDARY, TARGET, alphabet_size, index_symbol, symbol_index
from gridloom.operators.pyramid import SCHEMES, Pyramid, decompress_cells
from gridloom.plans.domain import Domain, Layout, pyramid_dims
from gridloom.plans.storage import shared_folder, written
from gridloom.plans.types import Elem

#: Cells that are coded together; chunks are coded in parallel and each by itself.
CHUNK = 1 << 18
STREAM = "var string, level int, chunk long, first long, n long, alphabet binary, codes binary, data binary"


def symbol_frequencies(pyramid: Pyramid) -> DataFrame:
    """``var, level, symbol, n``; the boundary symbol counts once per level."""
    found = pyramid.residuals.filter(F.col("symbol").isNotNull()).groupBy("var", "level", "symbol").agg(F.count("*").alias("n"))
    # the boundary goes beside a level's first symbol, so residuals are counted once
    first = F.row_number().over(W.partitionBy("var", "level").orderBy("symbol")) == 1
    own, end = F.struct("symbol", "n"), F.struct(long(BOUNDARY).alias("symbol"), long(1).alias("n"))
    rows = found.withColumn("_first", first).select("var", "level", F.explode(F.when(F.col("_first"), F.array(own, end)).otherwise(F.array(own))).alias("e"))
    return rows.select("var", "level", "e.symbol", "e.n")


def cumulative_frequencies(frequencies: DataFrame, scheme: str, width: int) -> DataFrame:
    """``var, level, place, symbol, n, scaled, upto``: frequencies scaled to about 16350 in all, at least 1 each, and their running sums."""
    level = W.partitionBy("var", "level")
    total = F.sum("n").over(level).cast("double") / F.lit(float(TARGET))
    rows = frequencies.withColumn("place", symbol_index(F.col("symbol"), scheme, width))
    rows = rows.withColumn("scaled", F.greatest(F.floor(F.col("n").cast("double") / total), long(1)))
    running = level.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("var", "level", "place", "symbol", "n", "scaled", F.sum("scaled").over(running).alias("upto"))


def level_entropy(frequencies: DataFrame) -> DataFrame:
    """``var, level, symbols, entropy_bits``: what an ideal coder takes for the symbols."""
    rows = frequencies.filter(F.col("symbol") != BOUNDARY)
    rows = rows.withColumn("total", F.sum("n").over(W.partitionBy("var", "level")))
    each = -F.col("n") * F.log2(F.col("n") / F.col("total"))
    return rows.groupBy("var", "level").agg(F.sum("n").alias("symbols"), F.sum(each).alias("entropy_bits"))


def level_byte_offsets(sizes: DataFrame, bytes_column: str = "payload_bytes", by: tuple[str, ...] = ("var",), order: tuple[str, ...] = ("level",), descending: bool = True) -> DataFrame:
    """Adds ``byte_offset``: bytes of all that goes before, coarsest level first."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) if descending else F.asc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("byte_offset", F.coalesce(F.sum(bytes_column).over(w), long(0)))


def with_level_position(rows: DataFrame, pyramid: Pyramid, order: str = "row") -> DataFrame:
    """Adds ``pos``, a residual's place in its level: by row-major coordinates, or (``morton``) its key."""
    if order == "morton":
        return rows.withColumn("pos", F.col("m"))
    layout, dims = pyramid.meta.layout, pyramid.dims
    axes = [*reversed(layout.axes)]
    rows = rows.withColumns({f"_{a}": c for a, c in zip(axes, morton_decode(F.col("m"), len(axes)), strict=True)})
    out = F.lit(None).cast("long")
    for level in range(pyramid.depth, -1, -1):
        out = F.when(F.col("level") == level, linearize(layout, Domain.default(layout, dims[level]), {a: F.col(f"_{a}") for a in axes})).otherwise(out)
    return rows.withColumn("pos", out).drop(*[f"_{a}" for a in axes])


def _tables(pyramid: Pyramid, frequencies: DataFrame) -> dict[tuple[str, int], list[int]]:
    """Running sums of every level: a few dozen entries each, so they fit in the driver and in each task."""
    size = alphabet_size(pyramid.scheme, pyramid.meta.elem.width)
    counts: dict[tuple[str, int], np.ndarray] = {}
    rows = frequencies.withColumn("place", symbol_index(F.col("symbol"), pyramid.scheme, pyramid.meta.elem.width))
    for r in rows.select("var", "level", "place", "n").collect():
        counts.setdefault((r["var"], r["level"]), np.zeros(size, np.int64))[r["place"]] += r["n"]
    return {k: arithmetic.cumulative(v) for k, v in counts.items()}


def _coded_rows(pyramid: Pyramid, chunk: int | None, order: str) -> tuple[DataFrame, dict[tuple[str, int], list[int]]]:
    """``var, level, chunk, pos, place, nbits, payload`` of all levels and the top, and the tables of those that have codes."""
    elem, scheme, depth = pyramid.meta.elem, pyramid.scheme, pyramid.depth
    root = pyramid.root
    if scheme == "prefix":
        nbits = F.col("len").cast("int")
        body = F.when(nbits == 0, long(0)).otherwise(F.call_function("shiftrightunsigned", F.col("bits"), F.lit(elem.width) - nbits))
        top = root.select("var", F.lit(depth).alias("level"), "m", nbits.alias("nbits"), body.alias("payload"), nbits.cast("long").alias("symbol"))
    else:
        top = root.select("var", F.lit(depth).alias("level"), "m", F.lit(elem.width).alias("nbits"), F.col("bits").alias("payload"), F.lit(None).cast("long").alias("symbol"))
    rows = pyramid.residuals.unionByName(top)
    with_top = Pyramid(scheme, pyramid.meta, depth, rows, root)
    rows = with_level_position(rows, pyramid, order).withColumn("place", symbol_index(F.col("symbol"), scheme, elem.width))
    rows = rows.withColumn("chunk", F.call_function("div", F.col("pos"), long(chunk)) if chunk else long(0))
    coded = with_top.residuals if scheme != "prefix" else with_top.residuals.filter((F.col("level") > 0) | F.lit(depth == 0))
    tables = _tables(pyramid, symbol_frequencies(Pyramid(scheme, pyramid.meta, depth, coded, root)))
    return rows.select("var", "level", "chunk", "pos", "place", "nbits", "payload"), tables


def encode(pyramid: Pyramid, chunk: int | None = CHUNK, order: str = "row") -> DataFrame:
    """The pyramid as records: a row per level and chunk with its table, symbol codes and packed payloads.

    Cells of one chunk meet in one task, in order; ``chunk`` None makes one chunk per level. The finest level of the prefix
    scheme has no codes, as lengths follow from the level above. The top values are level ``depth``.
    """
    last = alphabet_size(pyramid.scheme, pyramid.meta.elem.width) - 1
    rows, tables = _coded_rows(pyramid, chunk, order)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        var, level, part = key
        pdf = pdf.sort_values("pos")
        codes, alphabet = b"", b""
        if (var, level) in tables:
            cum = tables[var, level]
            places = pdf["place"].dropna().astype(int).tolist()
            codes, alphabet = arithmetic.encode([*places, last], cum), arithmetic.table_bytes(cum)
        data = pack_fields(pdf["payload"].to_numpy(), pdf["nbits"].to_numpy())
        return pd.DataFrame({"var": [var], "level": [level], "chunk": [part], "first": [int(pdf["pos"].iloc[0])], "n": [len(pdf)], "alphabet": [alphabet], "codes": [codes], "data": [data]})

    return rows.groupBy("var", "level", "chunk").applyInPandas(run, STREAM)


def encode_whole(pyramid: Pyramid, folder: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """What ``encode`` gives for one chunk per level, without a level's cells in one task.

    Payloads stay in pieces, ``var, level, chunk, bits, data``, to be put on end bit by bit; codes, which are one sequence
    per level, are ``var, level, alphabet, codes``, made from one byte per symbol.
    """
    last = alphabet_size(pyramid.scheme, pyramid.meta.elem.width) - 1
    rows, tables = _coded_rows(pyramid, chunk, "row")

    def cut(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        places = pdf["place"].dropna().astype(np.uint8).to_numpy().tobytes() if key[:2] in tables else b""
        data = pack_fields(pdf["payload"].to_numpy(), pdf["nbits"].to_numpy())
        return pd.DataFrame({"var": [key[0]], "level": [key[1]], "chunk": [key[2]], "bits": [int(pdf["nbits"].sum())], "places": [places], "data": [data]})

    def code(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cum, parts = tables[key], pdf.sort_values("chunk")["places"]
        codes = arithmetic.encode_parts([*(np.frombuffer(p, np.uint8) for p in parts), [last]], cum)
        return pd.DataFrame({"var": [key[0]], "level": [key[1]], "alphabet": [arithmetic.table_bytes(cum)], "codes": [codes]})

    pieces = written(rows.groupBy("var", "level", "chunk").applyInPandas(cut, "var string, level int, chunk long, bits long, places binary, data binary"), f"{folder}/pieces")
    coded = pieces.filter(F.octet_length("places") > 0).select("var", "level", "chunk", "places")
    codes = written(coded.groupBy("var", "level").applyInPandas(code, "var string, level int, alphabet binary, codes binary"), f"{folder}/codes")
    return pieces.drop("places"), codes


def _lengths(places: np.ndarray, scheme: str, width: int) -> np.ndarray:
    """Payload bits that symbols stand for."""
    if scheme == "prefix":
        return places
    zeros = np.where(places > width, places - (width + 1), places)
    return np.maximum(width - 1 - zeros, 0)


def decode_symbols(stream: DataFrame, scheme: str, elem: Elem) -> DataFrame:
    """``var, level, pos, place, nbits, payload`` of records that have codes; each record is decoded by itself."""
    width = elem.width

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                at, skip = r.first, 0
                for places in arithmetic.decode_parts(r.codes, arithmetic.table_from(r.alphabet)):
                    nbits = _lengths(places, scheme, width)
                    size = skip + int(nbits.sum())
                    body = unpack_fields(r.data[skip // 8 : -(-size // 8)], nbits, skip % 8)
                    yield pd.DataFrame({"var": r.var, "level": r.level, "pos": at + np.arange(len(places)), "place": places, "nbits": nbits, "payload": body})
                    at, skip = at + len(places), size

    rows = stream.filter(F.octet_length("codes") > 0).select("var", "level", "first", "alphabet", "codes", "data")
    return rows.mapInPandas(run, "var string, level int, pos long, place int, nbits int, payload long")


def _keyed(rows: DataFrame, level_dims: list[tuple[int, ...]], layout: Layout) -> DataFrame:
    """Adds the Morton key ``m`` of row-major places."""
    axes = [*reversed(layout.axes)]
    coords = {a: F.lit(None).cast("long") for a in axes}
    for level, dims in enumerate(level_dims):
        here = delinearize(layout, Domain.default(layout, dims), F.col("pos"))
        coords = {a: F.when(F.col("level") == level, here[a]).otherwise(coords[a]) for a in axes}
    rows = rows.withColumns({f"_{a}": c for a, c in coords.items()})
    return rows.withColumn("m", morton_encode(*[F.col(f"_{a}") for a in axes])).drop(*[f"_{a}" for a in axes])


def decode(stream: DataFrame, scheme: str, meta, depth: int, leaves: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``var, m, bits, len`` of the cells from records in row-major order; ``leaves`` gives other records of the finest prefix level from its parents."""
    kind, layout = meta.elem, meta.layout
    dim, dims = layout.dimensionality, pyramid_dims(meta.lengths, depth)
    coder = SCHEMES[scheme](kind)
    found = _keyed(decode_symbols(stream, scheme, kind), dims, layout).withColumn("symbol", index_symbol(F.col("place"), scheme, kind.width))
    # written, as each tile step on the way down reads its own levels and would decode all records for them
    residuals = written(found.select("var", "level", "m", "nbits", "payload", "symbol"), f"{shared_folder(stream.sparkSession)}/decoded")
    if scheme == "multires":
        whole = stream.filter(F.col("level") == depth).select("var", "level", F.col("first").alias("pos"), "data")
        root = _keyed(whole, dims, layout).select("var", "m", F.conv(F.hex("data"), 16, -10).cast("long").alias("bits") if kind.width < 64 else _signed(F.col("data")).alias("bits"), F.lit(kind.width).alias("len"))
        return decompress_cells(Pyramid(scheme, meta, depth, residuals, root), dim, coder)
    top = residuals.filter(F.col("level") == depth)
    shift = F.lit(kind.width) - F.col("nbits")
    root = top.select("var", "m", F.when(F.col("nbits") == 0, long(0)).otherwise(F.call_function("shiftleft", F.col("payload"), shift)).alias("bits"), F.col("nbits").alias("len"))
    above = decompress_cells(Pyramid(scheme, meta, depth, residuals, root), dim, coder, stop=1)
    if leaves:
        above = written(above, f"{shared_folder(above.sparkSession)}/above")
        fine = leaf_residuals(leaves(above), above, meta, dims, CHUNK)
    else:
        fine = leaf_residuals(stream.filter(F.col("level") == 0), above, meta, dims)
    return decompress_cells(Pyramid(scheme, meta, 1, fine, above), dim, coder)


def _signed(data: Column) -> Column:
    """Eight bytes as a pattern."""
    high, low = (F.conv(F.substring(F.hex(data), at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)


def leaf_lengths(above: DataFrame, meta, dims: list[tuple[int, ...]]) -> DataFrame:
    """``var, m, pos, nbits`` of the cells of the finest prefix level: what their parents lack."""
    layout, width, dim = meta.layout, meta.elem.width, meta.layout.dimensionality
    axes = [*reversed(layout.axes)]
    # places are found per parent, and filtered behind the children, as a filter would take the whole expressions with it
    up = {f"_{a}": x for a, x in zip(axes, morton_decode(F.col("m"), dim), strict=True)}
    cells = above.select("var", "m", (F.lit(width) - F.col("len")).alias("nbits"), *[c.alias(n) for n, c in up.items()])
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << dim) - 1))).alias("c"))
    coords = {a: F.col(f"_{a}") * 2 + F.shiftright("c", k).bitwiseAND(F.lit(1)) for k, a in enumerate(axes)}
    pos = linearize(layout, Domain.default(layout, dims[0]), coords)
    cells = cells.select("var", (F.call_function("shiftleft", F.col("m"), F.lit(dim)) + F.col("c")).alias("m"), pos.alias("pos"), "nbits")
    return cells.filter(F.col("pos").isNotNull())


def leaf_residuals(stream: DataFrame, above: DataFrame, meta, dims: list[tuple[int, ...]], chunk: int | None = None) -> DataFrame:
    """Residuals of the finest prefix level, whose lengths are what their parents lack; records meet their own cells only.

    A record's payloads start after ``skip`` bits, where it has such a column; ``chunk`` is the number of cells of every record, if that is known.
    """
    cells = leaf_lengths(above, meta, dims)
    stream = stream.select("var", "first", "data", "skip" if "skip" in stream.columns else F.lit(0).alias("skip"))
    if chunk:
        cells = cells.withColumn("first", F.call_function("div", F.col("pos"), long(chunk)) * chunk)
    else:
        marks = stream.groupBy("var").agg(F.sort_array(F.collect_list("first")).alias("firsts"))  # one number per record
        cells = cells.join(F.broadcast(marks), "var").withColumn("first", F.array_max(F.filter("firsts", lambda f: f <= F.col("pos"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos")
        body = unpack_fields(right["data"].iloc[0], left["nbits"].to_numpy(), int(right["skip"].iloc[0]))
        return pd.DataFrame({"var": left["var"], "level": 0, "m": left["m"], "nbits": left["nbits"], "payload": body, "symbol": left["nbits"].astype("int64")})

    pairs = cells.select("var", "first", "m", "pos", "nbits").groupBy("var", "first").cogroup(stream.groupBy("var", "first"))
    return pairs.applyInPandas(run, "var string, level int, m long, nbits int, payload long, symbol long")


def encode_suffixes(rows: DataFrame, method: str, order: str = "pos", by: tuple[str, ...] = ("chunk",)) -> DataFrame:
    """Ordered suffixes (``payload, nbits``) of each group by one of the alternative encoders: the keys, ``n`` and ``data``."""
    return encode_suffixes_by(rows, (method,), order, by).drop("method")


def encode_suffixes_by(rows: DataFrame, methods: tuple[str, ...], order: str = "pos", by: tuple[str, ...] = ("chunk",)) -> DataFrame:
    """As ``encode_suffixes`` by several encoders: ``method``, the keys, ``n`` and ``data``. Suffixes move and are ordered once for all."""
    kinds = dict(rows.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        payload, nbits = pdf["payload"].to_numpy(), pdf["nbits"].to_numpy().astype(np.int64)
        data = [suffixes.ENCODERS[m](payload, nbits) for m in methods]
        return pd.DataFrame({"method": methods, **{c: [k] * len(methods) for c, k in zip(by, key, strict=True)}, "n": [len(pdf)] * len(methods), "data": data})

    return rows.groupBy(*by).applyInPandas(run, "method string, " + ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, data binary")


def xor_with_previous(rows: DataFrame, order: str = "pos", by: tuple[str, ...] = ("chunk",)) -> DataFrame:
    """Adds ``xored``: each payload XOR the one before it in its group, within its own length."""
    before = F.coalesce(F.lag("payload").over(W.partitionBy(*by).orderBy(order)), long(0))
    ones = F.when(F.col("nbits") >= 64, long(-1)).otherwise(F.call_function("shiftleft", long(1), F.least(F.col("nbits"), F.lit(62)).cast("int")) - 1)
    ones = F.when(F.col("nbits") == 63, long((1 << 63) - 1)).otherwise(ones)
    return rows.withColumn("xored", F.col("payload").bitwiseXOR(before).bitwiseAND(ones))


def huffman_codes(frequencies: DataFrame, scheme: str, width: int) -> DataFrame:
    """``var, level, symbol, n, code, code_bits``: codes built per level from its table of a few dozen symbols."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from gridloom.functions import huffman

        table = huffman.codes(dict(zip(pdf["symbol"].tolist(), pdf["n"].tolist(), strict=True)))
        pdf = pdf.assign(code=[table[s][0] for s in pdf["symbol"]], code_bits=[table[s][1] for s in pdf["symbol"]])
        return pdf[["var", "level", "symbol", "n", "code", "code_bits"]]

    return frequencies.groupBy("var", "level").applyInPandas(run, "var string, level int, symbol long, n long, code long, code_bits int")
