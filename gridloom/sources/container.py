"""The single-file format of a compressed variable.

Six 32-bit numbers (element type, scheme, layout, dimensionality, number of level records, number of levels), the
lengths of all levels from coarse to fine, then a record per level from coarse to fine, all numbers with the highest
byte first. A record has the byte counts of itself, its table, its codes and its payload (64 bits each) and these parts;
of the finest prefix level only its own count and payload, of the top of a multi-resolution pyramid only the value.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.bits import long
from gridloom.operators.entropy import CHUNK, decode, encode_whole, leaf_lengths
from gridloom.operators.grid import Grid
from gridloom.operators.pyramid import Pyramid, grid_from_cells
from gridloom.plans.domain import Domain, GridMeta, Layout, pyramid_dims
from gridloom.plans.schemes import CODES
from gridloom.plans.storage import open_input, open_output, shared_folder, written
from gridloom.plans.types import by_code

#: Bytes of a file that are held together.
BLOCK = 1 << 20
_HEAD = struct.Struct(">6i")
_NAMES = {"prefix": "PatchPrefixExtractionPlainSuffixes", "multires": "PatchMultiResExtraction"}


#: Fixed value: the suffix of the format's files.
SUFFIX = ".cmc"


def file_name(prefix: str, variable: str) -> str:
    return f"{prefix}_{variable}{SUFFIX}"


def header(pyramid: Pyramid) -> bytes:
    meta, dims = pyramid.meta, pyramid.dims
    out = _HEAD.pack(meta.elem.code, CODES[_NAMES[pyramid.scheme]], meta.layout.code, meta.dimensionality, pyramid.depth + 1, len(dims))
    return out + b"".join(struct.pack(f">{len(d)}i", *d) for d in reversed(dims))


def write_container(pyramid: Pyramid, prefix: str) -> str:
    """Writes ``prefix_variable.cmc`` and gives its name; payloads pass through the driver in pieces, and are put on end there."""
    if pyramid.scheme not in _NAMES:
        raise ValueError(f"the single-file format has no {pyramid.scheme}")
    name = file_name(prefix, pyramid.meta.name)
    spark = pyramid.root.sparkSession
    pieces, codes = encode_whole(pyramid, shared_folder(spark), CHUNK)
    bits = {r["level"]: r["bits"] for r in pieces.groupBy("level").agg(F.sum("bits").alias("bits")).collect()}
    coded = {r["level"]: (bytes(r["alphabet"]), bytes(r["codes"])) for r in codes.collect()}  # up to a byte or so per coded cell
    out = open_output(spark, name)
    try:
        out.write(header(pyramid))
        level, rest, left = None, 0, 0  # bits that do not fill a byte yet
        for row in pieces.orderBy(F.desc("level"), "chunk").toLocalIterator():
            if row["level"] != level:
                if left:
                    out.write(bytes([rest << (8 - left)]))
                level, rest, left = row["level"], 0, 0
                out.write(opening(pyramid, level, -(-bits[level] // 8), *coded.get(level, (b"", b""))))
            # after what is left of the piece before
            size = left + row["bits"]
            number = int.from_bytes(row["data"], "big") >> (8 * len(row["data"]) - row["bits"]) | rest << row["bits"]
            rest, left = number & (1 << size % 8) - 1, size % 8
            out.write((number >> left).to_bytes(size // 8, "big"))
        if left:
            out.write(bytes([rest << (8 - left)]))
    finally:
        out.close()
    return name


def opening(pyramid: Pyramid, level: int, payload: int, alphabet: bytes, codes: bytes) -> bytes:
    """What goes before a level's payload of so many bytes."""
    if pyramid.scheme == "multires" and level == pyramid.depth:
        return b""
    if pyramid.scheme == "prefix" and level == 0 and pyramid.depth:
        return struct.pack(">Q", 8 + payload)
    sizes = [len(alphabet), len(codes), payload]
    return struct.pack(">4Q", 32 + sum(sizes), *sizes) + alphabet + codes


@dataclass(frozen=True)
class Container:
    """A read file: its description, the records (as ``encode`` gives them) of all levels but the finest prefix level, and where that one is in ``blocks``."""

    scheme: str
    meta: GridMeta
    depth: int
    stream: DataFrame
    blocks: DataFrame
    leaves_at: int | None

    def decompress(self) -> Grid:
        leaves = self._leaves if self.leaves_at is not None else None
        return grid_from_cells(decode(self.stream, self.scheme, self.meta, self.depth, leaves).select("var", "m", "bits"), self.meta)

    def _leaves(self, above: DataFrame) -> DataFrame:
        """Records of the finest prefix level, whose lengths the level above gives: cut where their cells' bits start."""
        lengths = leaf_lengths(above, self.meta, pyramid_dims(self.meta.lengths, self.depth))
        sizes = lengths.groupBy(F.call_function("div", F.col("pos"), long(CHUNK)).alias("chunk")).agg(F.sum("nbits").alias("bits"))
        spans, at = [], 0
        for r in sizes.orderBy("chunk").collect():  # one number per record
            first, end = self.leaves_at + at // 8, self.leaves_at - (-(at + r["bits"]) // 8)
            spans.append((0, r["chunk"] * CHUNK, at % 8, first, max(end, first + 1)))
            at += r["bits"]
        return _cut(self.blocks, spans).select(F.lit(self.meta.name).alias("var"), F.col("part").alias("first"), "skip", "data")


def _cut(blocks: DataFrame, spans: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """``level, part, skip, data`` of parts of a file, given with their first byte and the one after their last."""
    spans = blocks.sparkSession.createDataFrame(spans, "level int, part long, skip int, first long, end long")
    spans = spans.select("*", F.explode(F.sequence(F.call_function("div", F.col("first"), long(BLOCK)), F.call_function("div", F.col("end") - 1, long(BLOCK)))).alias("k"))
    start = F.col("k") * BLOCK
    low, high = F.greatest(F.col("first") - start, long(0)), F.least(F.col("end") - start, long(BLOCK))
    found = spans.join(blocks, "k", "left").select("level", "part", "skip", "k", F.coalesce(F.substring("block", (low + 1).cast("int"), (high - low).cast("int")), F.lit(b"")).alias("data"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"level": [key[0]], "part": [key[1]], "skip": [key[2]], "data": [b"".join(pdf.sort_values("k")["data"])]})

    return found.groupBy("level", "part", "skip").applyInPandas(run, "level int, part long, skip int, data binary")


def read_container(spark: SparkSession, prefix: str, variable: str) -> Container:
    """Reads the header and the records' sizes on the driver; the file is cut into blocks by the task that reads it."""
    name = file_name(prefix, variable)
    file = open_input(spark, name)
    try:
        code, scheme_code, layout_code, dim, records, levels = (file.readInt() for _ in range(6))
        schemes = {CODES[full]: short for short, full in _NAMES.items()}
        if scheme_code not in schemes:
            raise ValueError(f"{name} holds an unknown scheme: {scheme_code}")
        dims = [tuple(file.readInt() for _ in range(dim)) for _ in range(levels)]
        layout, kind = Layout.by_code(layout_code), by_code(code)
        depth, scheme, at = records - 1, schemes[scheme_code], _HEAD.size + 4 * dim * levels
        spans, leaves_at = [], None  # per level its alphabet, codes and payload
        for level in range(depth, -1, -1):
            if scheme == "multires" and level == depth:
                spans.append((level, 2, at, at + kind.width // 8))
                at += kind.width // 8
                continue
            file.seek(at)
            size = file.readLong()
            if scheme == "prefix" and level == 0 and depth:
                leaves_at = at + 8
            else:
                start = at + 32
                for part in range(3):
                    length = file.readLong()
                    spans.append((level, part, start, start + length))
                    start += length
            at += size
    finally:
        file.close()
    meta = GridMeta(variable, kind, layout, Domain.default(layout, dims[-1]))
    content = spark.read.format("binaryFile").load(name).select("content", F.explode(F.sequence(long(0), long(max(at - 1, 0) // BLOCK))).alias("k"))
    blocks = content.select("k", F.substring("content", (F.col("k") * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("block"))
    blocks = written(blocks.repartition("k"), f"{shared_folder(spark)}/blocks")
    parts = _cut(blocks, [(level, part, 0, first, end) for level, part, first, end in spans if end > first])
    of = lambda k: F.coalesce(F.max(F.when(F.col("part") == k, F.col("data"))), F.lit(b""))
    stream = parts.groupBy("level").agg(*[of(k).alias(n) for k, n in enumerate(("alphabet", "codes", "data"))])
    zero = long(0)
    stream = stream.select(F.lit(variable).alias("var"), "level", zero.alias("chunk"), zero.alias("first"), zero.alias("n"), "alphabet", "codes", "data")
    return Container(scheme, meta, depth, stream, blocks, leaves_at)
