"""Nearest neighbours from randomly rotated one-bit codes.

Each vector, less a fixed centre, is turned by a fixed random rotation and kept as the signs of its coordinates
(packed bits) with two scalars: its norm and the inner product of the unit vector with its code. For a query the
inner product with a code, divided by that scalar, estimates the true one; the error is bounded by a multiple of
sqrt((1 - s^2) / s^2 / (D - 1)), so each estimated distance has a lower and an upper bound. Only vectors whose lower bound
does not exceed the query's tenth smallest exact distance so far (or upper bound, at first) are computed exactly.

Codes are made once and written in order of coarse cells (the nearest of a few pivots). The stated queries are taken in blocks
of a bounded size, so a plan is the same for any number of them: each block goes to all tasks, each task scans its codes once and
writes the k nearest of each query, and the k nearest of those are the result. Vectors that lie together are skipped
together for each query whose k-th distance so far ends before the ball around them begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import discard, lean, shared_folder, written

#: Bytes of a block of queries, as doubles: what each task is given at once.
BLOCK_BYTES = 4 << 20
#: Queries and vectors that are held against each other at a time, and coarse cells.
QUERIES, VECTORS, CELLS = 512, 1024, 64
#: Width of the error bound, in standard deviations of the estimate.
EPSILON = 3.0


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows, their vectors): neither null nor zero, without null or non-finite components, of ``dim`` (or the first such row's) length."""
    rows, out = [], []
    for k, v in enumerate(column):
        v = v.values if v.is_valid else None
        if v is None or len(v) == 0 or v.null_count or dim not in (None, len(v)):
            continue
        x = np.asarray(v, dtype=np.float64)
        if np.isfinite(x).all() and x.any():
            dim = len(x)
            rows.append(k)
            out.append(x)
    return np.array(rows, np.int64), np.array(out, np.float64).reshape(len(rows), dim or 0)


def _vectors(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """As ``usable``, at once where all rows are alike."""
    if dim and not column.null_count and len(column):
        flat, offsets = column.flatten(), np.asarray(column.offsets)
        if not flat.null_count and (np.diff(offsets) == dim).all():
            x = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
            good = np.flatnonzero(np.isfinite(x).all(axis=1) & x.any(axis=1))
            return good, x[good]
    return usable(column, dim)


class Codes:
    """One-bit codes of vectors under a rotation, and the scalars that correct their estimates."""

    def __init__(self, bits: np.ndarray, norm: np.ndarray, scale: np.ndarray, dim: int):
        self.bits, self.norm, self.scale, self.dim = bits, norm, scale, dim

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        d = x.shape[1]
        o = (x - centre) @ turn
        norm = np.linalg.norm(o, axis=1)
        scale = np.divide(np.abs(o).sum(axis=1), norm * np.sqrt(d), out=np.ones(len(o)), where=norm > 0)
        return cls(np.packbits(o > 0, axis=1), norm, scale, d)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances to the turned, centred queries ``q``: (queries, vectors)."""
        d = self.dim
        signs = np.unpackbits(self.bits, axis=1, count=d).astype(np.float32) * (2 / np.sqrt(d)) - 1 / np.float32(np.sqrt(d))
        norm = np.linalg.norm(q, axis=1)
        inner = q.astype(np.float32) @ signs.T / self.scale.astype(np.float32)
        error = EPSILON * np.sqrt(np.maximum(1 - self.scale**2, 0) / self.scale**2 / max(d - 1, 1))
        middle = norm[:, None] ** 2 + self.norm[None] ** 2 - 2 * self.norm[None] * inner
        slack = 2 * np.outer(norm, self.norm * error) + 1e-5 * (norm[:, None] ** 2 + self.norm[None] ** 2)
        return middle - slack, middle + slack


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, added up component by component in double precision."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        step = a[:, k] - b[:, k]
        total += step * step
    return np.sqrt(total)


def _coded(rows: DataFrame, centre: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``cell, vec_id, v, bits, norm, scale`` of the usable rows, in order of cells."""
    dim = len(centre)
    turn = rotation(dim)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, VECTORS):
                part = whole.slice(at, VECTORS)
                good, x = _vectors(part.column(1), dim)
                named = np.asarray(part.column(0).is_valid())[good]
                good, x = good[named], x[named]
                if not len(good):
                    continue
                c = Codes.of(x, centre, turn)
                cell = ((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)).argmin(axis=1)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0).take(pa.array(good)), v, pa.array([b.tobytes() for b in c.bits], pa.binary()), pa.array(c.norm), pa.array(c.scale)], names=["cell", "vec_id", "v", "bits", "norm", "scale"])

    coded = rows.mapInArrow(lean(run), "cell int, vec_id long, v array<double>, bits binary, norm double, scale double")
    return coded.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")


class Best:
    """The k nearest of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.distance = np.full((queries, k), np.inf)
        self.name = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, distance: np.ndarray, name: np.ndarray) -> None:
        touched = np.unique(query)
        rows = np.concatenate([query, np.repeat(touched, self.k)])
        distance = np.concatenate([distance, self.distance[touched].ravel()])
        name = np.concatenate([name, self.name[touched].ravel()])
        order = np.lexsort((name, distance, rows))
        rows, distance, name = rows[order], distance[order], name[order]
        take = np.searchsorted(rows, touched)[:, None] + np.arange(self.k)
        self.distance[touched], self.name[touched] = distance[take], name[take]


def _scan(ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int, count: list[int] | None = None):
    """Holds codes against a block of queries; ``count`` gets how many distances each part took exactly."""
    dim = queries.shape[1]
    turned = (queries - centre) @ rotation(dim)

    def against(best: Best, name: np.ndarray, x: np.ndarray, codes: Codes) -> None:
        middle = x.mean(axis=0)
        radius = np.sqrt(((x - middle) ** 2).sum(axis=1).max())
        for at in range(0, len(ids), QUERIES):
            # no vector of the ball is nearer than the k-th so far
            q = at + np.flatnonzero((_distances(queries[at : at + QUERIES], middle[None]) - radius) * (1 - 1e-9) <= best.distance[at : at + QUERIES, -1])
            if not len(q):
                continue
            low, high = codes.bounds(turned[q])
            own = ids[q][:, None] == name[None]
            low[own] = high[own] = np.inf
            least = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(q), np.inf)
            limit = np.minimum(best.distance[q, -1] ** 2 * (1 + 1e-9), least)
            qi, xi = np.nonzero((low <= limit[:, None]) & ~own)
            if count is not None:
                count.append(len(qi))
            if len(qi):
                best.add(q[qi], _distances(queries[q[qi]], x[xi]), name[xi])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in it:
            for at in range(0, batch.num_rows, VECTORS):
                part = batch.slice(at, VECTORS)
                x = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(part.num_rows, dim)
                bits = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                against(best, np.asarray(part.column(0)), x, Codes(bits, np.asarray(part.column(3)), np.asarray(part.column(4)), dim))
        q, r = np.nonzero(np.isfinite(best.distance))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.name[q, r]), pa.array(best.distance[q, r])], names=["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` nearest rows of ``df`` to each row of ``queries``: ``query_id, rank, vec_id, score`` (Euclidean distance in double precision).

    Nearest first, ties to the smaller id; a query is no candidate of its own; all candidates, if there are fewer than ``k``.
    Rows whose vector is null, zero or empty, holds null or non-finite components, or differs in length from the
    first query, and rows with a null id, take no part. Repeated rows are candidates of their own, as often as they stand there; a
    repeated query is one query. Without queries the result is empty. Columns may have any names.

    Every row's code is held against every query, or its ball is, so the only loss is the error bound's own: at three deviations it is
    far below one neighbour in a thousand. Results of a task are at most ``k`` rows per query. The number of jobs grows with
    the queries, by one for each block of them.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    schema = "query_id long, vec_id long, score double"
    select = lambda x: x.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = select(queries).filter("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    asked = written(asked, folder, "asked")
    first = asked.orderBy("vec_id").limit(QUERIES).toArrow()
    good, x = usable(first["v"].combine_chunks()) if first.num_rows else (np.zeros(0, np.int64), np.zeros((0, 0)))
    if not len(good):  # look further for the first usable one
        sound = F.exists("v", lambda c: c != 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        first = asked.filter(sound).orderBy("vec_id").limit(QUERIES).toArrow()
        good, x = usable(first["v"].combine_chunks()) if first.num_rows else (good, x)
    if not len(good):
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    dim, centre = x.shape[1], x.mean(axis=0)
    codes = written(_coded(select(df), centre, x[:CELLS]), folder, "codes").select("vec_id", "v", "bits", "norm", "scale")
    blocks = max(1, -(-asked.count() * 8 * dim // block_bytes))
    asked = asked.filter(F.size("v") == dim).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    path = f"{folder}/blocks"
    asked.repartition("block").write.partitionBy("block").parquet(path)
    for number in range(blocks):
        block = spark.read.schema("vec_id long, v array<double>, block int").parquet(path).filter(F.col("block") == number).orderBy("vec_id").toArrow()
        good, x = usable(block["v"].combine_chunks(), dim) if block.num_rows else ([], None)
        if len(good):
            codes.mapInArrow(lean(_scan(np.asarray(block["vec_id"])[good], x, centre, k)), schema).write.mode("append").parquet(f"{folder}/near")
    discard(spark, f"{folder}/codes")
    near = spark.read.schema(schema).parquet(f"{folder}/near")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
