"""URL verdicts: longest-match rules, then exact membership of domains by a cascade of Bloom filters.

The universe of keys is complete: all hosts of the corpus and all domains that they are below. Level 1 of the cascade
holds the listed keys; the keys of the universe that it takes for listed, but are not, are level 2; those of the listed
that level 2 takes for such, level 3; and so on until a level errs on no key. So it answers for each key of the universe
exactly, and urls are judged row by row without a join.

Levels are sent to each executor once, as packed bits of a bounded size. What does not fit is cut into shards by hash of the key,
one cascade each, through which the rows go one after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import lean, mix, shared_folder, written

#: Bits of a shard's cascade, about (16 MB), and bits that a listed key takes in it, at most about.
SHARD_BITS, KEY_BITS = 1 << 27, 16
#: Rules (host, path, verdict) by contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Domains that are blocked with all below them, where no list is given.
LISTED = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "free-bets", "casino-win", "cheap-pills", "spam-farm") for top in ("com", "net", "org")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """As the rules read a url; both are empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), or nulls. Longest by host and path together; then the first in order of name."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def domains(host: Column) -> Column:
    """The host and all domains that it is below, as an array."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))


class Cascade:
    """Levels of (number of hashes, packed bits as words of 64) over keys that are known by two 64-bit hashes."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels

    @staticmethod
    def positions(a: np.ndarray, b: np.ndarray, level: int, hashes: int, bits: int) -> Iterator[np.ndarray]:
        for k in range(hashes):
            yield mix(mix(a + np.uint64(level * 64 + k)) ^ b) % np.uint64(bits)

    def depth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many levels hold each key before one that does not."""
        out, left = np.zeros(len(a), np.int64), np.arange(len(a))
        for level, (hashes, words) in enumerate(self.levels):
            held = np.ones(len(left), bool)
            for p in self.positions(a[left], b[left], level, hashes, 64 * len(words)):
                held &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            left = left[held]
            out[left] += 1
        return out

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.depth(a, b) % 2 == 1

    @classmethod
    def build(cls, keys: DataFrame) -> Cascade:
        """From distinct keys' hashes ``a, b`` and ``listed``, complete for the universe."""
        context = keys.sparkSession.sparkContext
        levels: list[tuple[int, np.ndarray]] = []
        while True:
            level = len(levels)
            sent = context.broadcast(levels)  # SHARD_BITS, about
            truth = level % 2 == 0

            def astray(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known = cls(sent.value)
                for batch in rows:
                    a, b = (np.asarray(batch.column(k)).view(np.uint64) for k in (0, 1))
                    yield batch.filter(pa.array(known.depth(a, b) == level))

            inside = keys.filter("listed" if truth else "not listed").select("a", "b").mapInArrow(astray, "a long, b long")
            n = inside.count()
            if not n:
                sent.destroy()
                return cls(levels)
            rate = 0.5 if level else 0.1  # a first level that lets few pass, then levels of a bit or two per key
            size = max(1, -(-int(n / math.log(2) ** 2 * -math.log(rate)) // 64))
            hashes = min(8, max(1, round(64 * size / n * math.log(2))))

            def mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                words = np.zeros(size, np.uint64)
                for batch in rows:
                    a, b = (np.asarray(batch.column(k)).view(np.uint64) for k in (0, 1))
                    for p in cls.positions(a, b, level, hashes, 64 * size):
                        np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
                at = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["word", "bits"])

            words = np.zeros(size, np.uint64)
            found = inside.mapInArrow(lean(mark), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # ``size`` rows at most
            words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
            levels = [*levels, (hashes, words)]
            sent.destroy()


def _marked(rows: DataFrame, cascade: Cascade, shard: int, shards: int) -> DataFrame:
    """``rows`` with ``on_list`` set where the cascade holds one of a row's keys (``a, b``) that belong to its shard."""
    sent = rows.sparkSession.sparkContext.broadcast(cascade.levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cascade(sent.value)
        for batch in batches:
            a, b = (np.asarray(batch.column(k).flatten()).view(np.uint64) for k in (3, 4))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column(3).offsets)))
            use = a % np.uint64(shards) == np.uint64(shard)
            held = row[use][known.contains(a[use], b[use])]
            out = np.asarray(batch.column(5)).astype(bool)
            out[held] = True
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out)], names=batch.schema.names)

    return rows.mapInArrow(lean(run), "page_id long, host string, path string, a array<long>, b array<long>, on_list boolean")


def judge(df: DataFrame, rules: list[tuple[str, str, str]] | None = None, listed: list[str] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", shard_bits: int = SHARD_BITS) -> DataFrame:
    """Every row's ``page_id, host, path, rule, verdict``.

    The longest rule that fits decides. Where none fits, hosts that are on the list, or below a domain on it, are blocked and
    others allowed. ``listed`` is a list of domains or a table with a column ``domain``, in lower case. Null urls and urls without
    ``://`` have empty host and path, which no rule fits, and are allowed. Null and repeated ids pass row by row; an empty
    table or list is no error; other columns are not read, whatever their names; very long urls are read whole.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    listed = LISTED if listed is None else listed
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(x,) for x in listed], "domain string")
    universe = rows.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    listed = listed.select(F.col("domain").alias("key")).filter("key <> ''").distinct().withColumn("listed", F.lit(True))
    a, b = _hashes(F.col("key"))
    keys = universe.join(listed, "key", "left").select(a.alias("a"), b.alias("b"), F.coalesce("listed", F.lit(False)).alias("listed"))
    keys = written(keys, folder, "keys")
    shards = max(1, -(-keys.filter("listed").count() * KEY_BITS // shard_bits))
    both = lambda k: F.transform(domains(F.col("host")), lambda x: _hashes(x)[k])
    rows = rows.select("page_id", "host", "path", both(0).alias("a"), both(1).alias("b"), F.lit(False).alias("on_list"))
    for shard in range(shards):
        # as numpy takes the hash: unsigned
        own = keys.filter(F.pmod(F.pmod(F.shiftrightunsigned("a", 1), F.lit(shards)) * 2 + F.col("a").bitwiseAND(F.lit(1).cast("long")), F.lit(shards)) == shard)
        rows = _marked(rows, Cascade.build(own), shard, shards)
        if shard + 1 < shards:
            rows = written(rows, folder, f"marked-{shard}")
    rule, verdict = ruled(F.col("host"), F.col("path"), RULES if rules is None else rules)
    own = F.when(F.col("on_list"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
