"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network over them.

Every word has a sparse random index vector, drawn from its hash. Over the whole corpus each hashed word adds up the
index vectors of its neighbours; shrunk and centred, these sums are the word vectors. A document is pooled into
the mean and the root mean square of its word vectors, the mean of its words' own index vectors, that mean's length
and how often neighbours agree. The network learns from a bounded sample of labelled rows, a fifth of which
sets a temperature, so that scores are calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches, flat_bytes, lean, word_hashes, word_spans

BUCKETS, DIM, SEEDS, REACH = 1 << 14, 64, 4, 2
#: Labelled rows that are learnt from at most, the first by a hash of their id.
SAMPLE = 20_000
#: Rows of the matrix of sums that travel together.
_SLAB = 256
_SUMS = BUCKETS * (DIM + 1)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of texts on end: each word's text and bucket, the places and signs of its index vector, its hash."""
    starts, ends, bounds = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    places = [((h >> np.uint64(8 * k)) & np.uint64(DIM - 1)).astype(np.int64) for k in range(SEEDS)]
    signs = [((h >> np.uint64(8 * k + 6)) & np.uint64(1)).astype(np.float64) * 2 - 1 for k in range(SEEDS)]
    return text, (h >> np.uint64(40)).astype(np.int64) % BUCKETS, places, signs, h


def _neighbour_sums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each bucket the sum of its neighbours' index vectors and, last, its number of words."""
    text, bucket, places, signs, _ = _words(data, offsets)
    out = np.zeros(BUCKETS * DIM)
    for off in range(1, REACH + 1):
        same = text[off:] == text[:-off]
        for here, there in ((slice(None, -off), slice(off, None)), (slice(off, None), slice(None, -off))):
            base = bucket[here][same] * DIM
            for p, s in zip(places, signs, strict=True):
                out += np.bincount(base + p[there][same], weights=s[there][same], minlength=len(out))
    return np.concatenate([out.reshape(BUCKETS, DIM), np.bincount(bucket, minlength=BUCKETS)[:, None]], axis=1).astype(np.int64)


def neighbour_sums(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Over all texts; tasks add up, then slabs of the matrix are added up in two rounds. Its size does not depend on the corpus."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches(it, 0, 1 << 20):
            sums = _neighbour_sums(*flat_bytes(batch.column(0)))
            total = sums if total is None else total + sums
        if total is not None:
            slabs = [total[k : k + _SLAB].astype("<i8" if np.abs(total).max() >= 2**31 else "<i4").tobytes() for k in range(0, BUCKETS, _SLAB)]
            salt = int(total[:, -1].sum()) % 16
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(slabs))), pa.array([salt] * len(slabs), pa.int64()), pa.array(slabs, pa.binary())], names=["slab", "salt", "sums"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in it:
            for slab, salt, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                sums = np.frombuffer(x, "<i4" if len(x) == 4 * _SLAB * (DIM + 1) else "<i8").astype(np.int64)
                held[slab, salt] = held[slab, salt] + sums if (slab, salt) in held else sums
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array([x.astype("<i8").tobytes() for x in held.values()], pa.binary())], names=["slab", "salt", "sums"])

    schema = "slab long, salt long, sums binary"
    parts = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(lean(count), schema)
    parts = parts.repartition("slab", "salt").mapInArrow(add, schema).withColumn("salt", F.lit(0).cast("long")).repartition("slab").mapInArrow(add, schema)
    out = np.zeros((BUCKETS, DIM + 1), np.int64)
    for row in parts.collect():  # BUCKETS rows, in slabs
        out[row["slab"] * _SLAB : (row["slab"] + 1) * _SLAB] = np.frombuffer(row["sums"], "<i8").reshape(_SLAB, DIM + 1)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """A vector per bucket: what stands beside its words, less what stands beside any word, damped."""
    context, count = sums[:, :-1].astype(np.float64), sums[:, -1:].astype(np.float64)
    v = (context - count * context.sum(axis=0) / max(count.sum(), 1)) / np.sqrt(count + 10)
    return (np.sign(v) * np.log1p(np.abs(v))).astype(np.float32)


FEATURES = 3 * DIM + 2


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """A row of ``FEATURES`` per text; zeros for texts without words."""
    text, bucket, places, signs, h = _words(data, offsets)
    n = len(offsets) - 1
    total, square = np.zeros((n, DIM)), np.zeros((n, DIM))
    for lo in range(0, len(text), step):  # so that a long text costs no more memory than a short one
        t = text[lo : lo + step]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        v = vectors[bucket[lo : lo + step]]
        total[t[first]] += np.add.reduceat(v, first, axis=0)
        square[t[first]] += np.add.reduceat(v * v, first, axis=0)
    own = np.zeros(n * DIM)
    for p, s in zip(places, signs, strict=True):
        own += np.bincount(text * DIM + p, weights=s, minlength=n * DIM)
    own = own.reshape(n, DIM)
    count = np.maximum(np.bincount(text, minlength=n), 1)[:, None]
    agree = np.bincount(text[1:], weights=(h[1:] == h[:-1]) & (text[1:] == text[:-1]), minlength=n)[:, None] if len(text) else np.zeros((n, 1))
    own /= count
    return np.hstack([total / count, np.sqrt(square / count), own, np.linalg.norm(own, axis=1, keepdims=True), agree / count]).astype(np.float32)


class Network:
    """Two layers (a hidden one of rectified units, a logistic output), fitted by Adam from a fixed seed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, hidden: int = 24, rounds: int = 30, rate: float = 0.01):
        """``held``: rows that do not train, but set the temperature."""
        self.prior = (float((y == 1).sum()) + 1) / (len(y) + 2)
        self.weights: list[np.ndarray] | None = None
        self.temperature = 1.0
        fit = ~held if (~held).any() and len(np.unique(y[~held])) == 2 else np.ones(len(y), bool)
        if len(y) == 0 or len(np.unique(y[fit])) < 2:
            return  # one class or none: every score is the prior
        self.mean, self.spread = x[fit].mean(axis=0, dtype=np.float64), x[fit].std(axis=0, dtype=np.float64) + 1e-6
        z, t = self._scaled(x[fit]), y[fit].astype(np.float64)
        r = np.random.default_rng(5)
        w = [r.standard_normal((z.shape[1], hidden)) * np.sqrt(2 / z.shape[1]), np.zeros(hidden), r.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        first, second, k = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(max(rounds, 2500 // (1 + len(z) // 256))):
            order = r.permutation(len(z))
            for i in range(0, len(z), 256):
                a, b = z[order[i : i + 256]], t[order[i : i + 256]]
                h = np.maximum(a @ w[0] + w[1], 0)
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3][0], -30, 30))) - b) / len(a)
                back = d[:, None] * w[2] * (h > 0)
                k += 1
                for j, g in enumerate((a.T @ back + 1e-3 * w[0], back.sum(axis=0), h.T @ d + 1e-3 * w[2], np.array([d.sum()]))):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    w[j] -= rate * first[j] / (1 - 0.9**k) / (np.sqrt(second[j] / (1 - 0.999**k)) + 1e-8)
            if k > 4000:
                break
        self.weights = w
        if held.any():
            logit, truth = self.logits(x[held]), y[held]
            loss = lambda c: np.logaddexp(0, np.where(truth == 1, -logit, logit) / c).mean()
            self.temperature = float(min(np.exp(np.linspace(-1.5, 3, 91)), key=loss))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(self._scaled(x) @ w[0] + w[1], 0) @ w[2] + w[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -700, 700)))


def _read(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, and a network from ``sample`` of the rows that ``labels`` marks 0 or 1.

    Rows whose crc32 of the id as text leaves 1 modulo 3 are held out. An id with several labels counts by the least,
    an id with several texts by that of the smallest hash.
    """
    vectors = word_vectors(neighbour_sums(df, text_col))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1, 1 << 20):
            x = pooled(vectors, *flat_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([a.tobytes() for a in x], pa.binary())], names=["doc_id", "y", "text_hash", "x"])

    rows = _read(df, id_col, text_col).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y", F.xxhash64("text").alias("text_hash"))  # `sample` ids at most
    rows = rows.mapInArrow(lean(run), "doc_id long, y int, text_hash long, x binary")
    found = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("x", "text_hash").alias("x")).toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, FEATURES)
    ids = found["doc_id"].to_numpy(dtype=np.int64)
    held = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(5) == 0
    return vectors, Network(x, found["y"].to_numpy(dtype=np.int64), held)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """Scores every whole text: ``doc_id, held_out, score, predicted``, then the columns named in ``keep``.

    Only the text is an input of a score. Null and empty texts are scored from empty features like any other; a null
    id is held out false; repeated rows are scored each. Without two classes among the labels every score is the share
    of the one. An empty table gives an empty one; columns may have any names.
    """
    vectors, network = fit(df, labels, id_col, text_col, label_col, sample)
    rest = F.struct(F.lit(0).alias("_"), *[F.col(x).alias(f"c{k}") for k, x in enumerate(keep)]).alias("rest")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1, 1 << 20):
            score = network.scores(pooled(vectors, *flat_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), batch.column(2)], names=["doc_id", "score", "predicted", "rest"])

    rows = _read(df, id_col, text_col, rest)
    out = rows.mapInArrow(lean(run), f"doc_id long, score double, predicted int, rest {rows.schema['rest'].dataType.simpleString()}")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", *[F.col(f"rest.c{k}").alias(x) for k, x in enumerate(keep)])
