"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are made by Spark's own hash and Arrow batches of it. Equal fingerprints become one row with the
smallest id. Each distinct fingerprint then goes to four groups, one for each 16-bit block: two that differ in at
most three bits share a block. Groups above a size are dealt again by blocks of their other bits, which again lose
no pair, until they are small or all bits are used. Within a task the groups are sorted by Gray rank and indexed: each
upper node holds the bits that all fingerprints below share, pairs of nodes are pruned as soon as their shared bits
differ in more than three places, and nodes whose members can differ in three bits at most are linked without being
opened. Only a spanning forest of links leaves a task; components are found by alternating stars over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import lean, shared_folder, words, written

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of more fingerprints than this are dealt again.
GROUP = 4096
_FAN = 8


def shingle_hashes(df: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """``doc_id, h``: XXH64 (seed 42) of each ``width``-word shingle of the text with A-Z lower-cased; fewer words: of all of them."""
    text = F.translate(F.col(text_col).cast("string"), CAPITALS, SMALL)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), words(text).alias("w"))
    rows = rows.select("doc_id", "w", F.size("w").alias("n"))  # each used often below, so neither is put in there again
    shingles = F.transform(
        F.slice("w", 1, F.greatest(F.col("n") - (width - 1), F.lit(0))),
        lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(F.col("w"), i + k) for k in range(1, width)])),
    )
    whole = F.array(F.xxhash64(F.array_join("w", " ")))
    return rows.select("doc_id", F.when(F.col("n") >= width, shingles).when(F.col("n") > 0, whole).otherwise(F.array().cast("array<bigint>")).alias("h"))


def majority(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that over half of each run of ``counts`` values have; zero for none."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.cumsum(counts[full]) - counts[full]
        for bit in range(64):
            ones = np.add.reduceat(((values >> np.uint64(bit)) & np.uint64(1)).astype(np.uint32), starts)
            out[full] |= (2 * ones.astype(np.int64) > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp``: the 64-bit SimHash of every whole text, repeats of shingles included; zero for texts without words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            column = batch.column(1)
            values = np.asarray(column.flatten()).view(np.uint64)
            out = majority(values, np.diff(np.asarray(column.offsets)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return shingle_hashes(df, id_col, text_col, width).mapInArrow(lean(run), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in Gray order: neighbours in that order differ in one bit."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Groups of fingerprints in Gray order, below nodes that hold what their members share.

    ``levels[0]`` are the fingerprints; each node of ``levels[k + 1]`` covers up to eight neighbours of one group in
    ``levels[k]``, up to one root per group. A node has the AND and the OR of its members: bits where these agree are
    the node's masked pattern.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), group))
        self.fp = fp[self.order]
        group = group[self.order]
        self.levels = [(self.fp, self.fp, np.arange(len(fp)), np.arange(len(fp)) + 1)]
        while True:
            low, high, *_ = self.levels[-1]
            first = np.ones(len(group), bool)
            first[1:] = group[1:] != group[:-1]
            begin = np.flatnonzero(first)
            if len(begin) == len(group):
                break
            within = np.arange(len(group)) - begin[np.cumsum(first) - 1]
            starts = np.flatnonzero(within % _FAN == 0)
            ends = np.append(starts[1:], len(group))
            self.levels.append((np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts), starts, ends))
            group = group[starts]

    def links(self, most: int, budget: int = 1 << 21) -> np.ndarray:
        """Smallest member (place in Gray order) that each fingerprint is linked to within its group, over any number of links."""
        label = np.arange(len(self.fp))
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        spans = self._spans()
        while stack:
            level, a, b = stack.pop()
            if len(a) > budget:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            low, high, starts, ends = self.levels[level]
            both = ~(low[a] ^ high[a]) & ~(low[b] ^ high[b])  # the shared bits of both
            keep = np.bitwise_count((low[a] ^ low[b]) & both) <= most
            a, b = a[keep], b[keep]
            if level:
                s, e = spans[level]
                least, largest = np.minimum.reduceat(label, s), np.maximum.reduceat(label, s)
                done = (least[a] == largest[a]) & (least[b] == largest[b]) & (least[a] == least[b])
                a, b = a[~done], b[~done]
                varying = np.bitwise_count((low[a] & low[b]) ^ (high[a] | high[b]))
                close = varying <= most
                for x in (a[close], b[close]):  # whole nodes at once: all their members link
                    self._join(label, *self._chain(s[x], e[x]))
                self._join(label, s[a[close]], s[b[close]])
                a, b = a[~close], b[~close]
                na, nb = ends[a] - starts[a], ends[b] - starts[b]
                each = na * nb
                total = int(each.sum())
                if total:
                    pair = np.repeat(np.arange(len(a)), each)
                    at = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
                    x, y = starts[a][pair] + at // nb[pair], starts[b][pair] + at % nb[pair]
                    up = x <= y if level > 1 else x < y
                    keep = up | (a != b)[pair]
                    stack.append((level - 1, x[keep], y[keep]))
            else:
                self._join(label, a[a != b], b[a != b])
        return label

    def _spans(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each level's nodes, the first fingerprint and the end."""
        out = [(self.levels[0][2], self.levels[0][3])]
        for _, _, starts, ends in self.levels[1:]:
            s, e = out[-1]
            out.append((s[starts], e[ends - 1]))
        return out

    @staticmethod
    def _chain(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = e - s
        first = np.repeat(s, n)
        return first, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first

    @staticmethod
    def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Puts the smallest label of all that the links (a, b) reach on each end."""
        while len(a):
            x, y = label[a], label[b]
            keep = x != y
            if not keep.any():
                break
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _blocks(start: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """Bits, as (from, to) ranges, in ``parts`` portions as even as can be."""
    bits = [b for s, e in start for b in range(s, e)]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        ranges: list[tuple[int, int]] = []
        for b in bits[lo:hi]:
            if ranges and ranges[-1][1] == b:
                ranges[-1] = (ranges[-1][0], b + 1)
            else:
                ranges.append((b, b + 1))
        out.append(ranges)
    return out


def _mask(ranges: list[tuple[int, int]]) -> int:
    m = sum(((1 << (e - s)) - 1) << s for s, e in ranges)
    return m - (1 << 64) if m >= 1 << 63 else m


def _dealt(fps: DataFrame, used: list[tuple[int, ...]], most: int) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Each fingerprint with each of its groups: ``fp, path, key``. ``used`` are the block paths that are dealt further."""
    paths, masks = [], []
    for path in used:
        left, taken = [(0, 64)], 0
        for k in path:
            blocks = _blocks(left, most + 1)
            taken |= _mask(blocks[k]) & (1 << 64) - 1
            left = [r for j, block in enumerate(blocks) if j != k for r in block]
        for k, block in enumerate(_blocks(left, most + 1)):
            if block:
                m = taken | _mask(block) & (1 << 64) - 1
                paths.append((*path, k))
                masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    groups = F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(groups).alias("g")).select("fp", "g.path", "g.key"), paths


def _linked(groups: DataFrame, most: int) -> DataFrame:
    """Links ``a, b`` (a below b) that span each group's components. Rows of a group meet in one task, in order."""

    def forest(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        index = GrayIndex(group, fp.view(np.uint64))
        label = index.links(most)
        child = np.flatnonzero(label != np.arange(len(label)))
        a, b = index.fp[label[child]].view(np.int64), index.fp[child].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush(whole: bool) -> pa.RecordBatch | None:
            path, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            change = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            to = len(fp) if whole else int(change[-1]) if len(change) else 0
            held[:] = [(path[to:], key[to:], fp[to:])] if to < len(fp) else []
            if not to:
                return None
            group = np.zeros(to, np.int64)
            group[change[change < to]] = 1
            return forest(np.cumsum(group), fp[:to])

        for batch in rows:
            if batch.num_rows:
                held.append(tuple(np.asarray(batch.column(k)) for k in range(3)))
                count += batch.num_rows
                if count >= 1 << 17:
                    if out := flush(False):
                        yield out
                    count = sum(len(x[0]) for x in held)
        if held and (out := flush(True)):
            yield out

    return groups.repartition("path", "key").sortWithinPartitions("path", "key").select("path", "key", "fp").mapInArrow(lean(run), "a long, b long")


def links(fps: DataFrame, folder: str, most: int = 3, group: int = GROUP) -> DataFrame:
    """Spanning links between distinct fingerprints (column ``fp``) that differ in at most ``most`` bits."""
    used: list[tuple[int, ...]] = [()]
    left, found, depth = fps.select("fp"), [], 0
    while True:
        dealt, paths = _dealt(left, used, most)
        deepest = all(len(p) * 16 >= 64 for p in paths) or depth >= 5
        if not deepest:
            sizes = dealt.groupBy("path", "key").count().filter(F.col("count") > group).select("path", "key")
            large = written(sizes, folder, f"large-{depth}")
            hot_paths = [r["path"] for r in large.select("path").distinct().collect()]  # at most as many as there are block paths
        if deepest or not hot_paths:
            found.append(_linked(dealt, most))
            break
        found.append(_linked(dealt.join(large, ["path", "key"], "left_anti"), most))
        left = written(dealt.join(large, ["path", "key"], "left_semi").select("fp").distinct(), folder, f"left-{depth}")
        used, depth = [paths[p] for p in hot_paths], depth + 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return written(out.distinct(), folder, "links")


def components(edges: DataFrame, folder: str, name: str = "stars") -> DataFrame:
    """``node, root``: the smallest node that each node of the links ``a, b`` reaches; nodes without links are absent.

    Alternating stars: each node hands its smallest neighbour to all its larger neighbours, then to all its smaller
    ones, until no link changes. Links per node are aggregated (a minimum), never gathered, and the minima are
    written before links are joined to them, so Spark can split the links of a hub.
    """
    now, k = written(edges.select("a", "b").distinct(), folder, f"{name}-edges"), 0
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), folder, f"{name}-{k}-least")
        # large star: what is larger than u links to u's least neighbour
        big = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        big = written(big.distinct(), folder, f"{name}-{k}-large")
        # small star: u's smaller neighbours and u itself link to the smallest
        least = written(big.groupBy("b").agg(F.min("a").alias("m")), folder, f"{name}-{k}-least-large")
        small = big.join(least, "b")
        small = small.filter(F.col("a") > F.col("m")).select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a < b").distinct()
        small = written(small, folder, f"{name}-{k}-small")
        total = small.agg(F.count("*").alias("n"), F.count_distinct("b").alias("d")).first()
        if total["n"] == total["d"] and not small.join(small.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            return small.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(small.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        now, k = small, k + 1


def least_of_components(nodes: DataFrame, roots: DataFrame, folder: str, key: str) -> DataFrame:
    """``key, component_id``: the least ``least`` of all nodes of each one's component; ``nodes`` without a root are their own."""
    member = nodes.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    least = written(member.groupBy("root").agg(F.min("least").alias("component_id")), folder, f"least-of-{key}")  # a plain side of the join, so Spark can split a large component
    return member.join(least, "root").select(key, "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3, group: int = GROUP) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; fingerprints link at ``most`` or fewer differing bits.

    ``fingerprint`` has 16 lower-case hex digits; ``component_id`` is the smallest id reachable over any number of
    links. Null and empty texts, and texts of white space alone, have fingerprint zero and link like any other; rows
    with a null id keep it, belong to a component like others, and name none (a component of null ids alone has a
    null component_id). Repeated rows come out repeated. An empty table gives an empty one; other columns are not read.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    fps = written(fingerprints(df, id_col, text_col, width), folder, "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "distinct")
    roots = components(links(distinct, folder, most, group), folder)
    nodes = least_of_components(distinct, roots, folder, "fp")
    return fps.join(nodes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
