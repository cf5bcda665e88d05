"""Near-duplicates by exact similarity: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

SimHash finds the nearest pairs cheaply; what its bits cannot reach is found by prefixes. In any order of all shingles two sets
that similar share one of the first ``n // 5 + 1`` of each, so rows of these prefixes meet by shingle and no pair is
lost. Bitmaps of the sets rule out pairs that lack too much in one another, and every link is checked on the whole sets, which are
made for the documents of the pairs that are left alone.

A shingle's documents are first held against the one that is richest in common shingles, so a large group of near copies
costs a row per document and not per pair. Documents that are linked then are not paired again; all others of a shingle
are, where their places in the order leave room for enough common shingles. Shingles that a sample finds frequent come
last in the order, which decides how much work there is and no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm import simhash
from gridloom.llm.common import batches, discard, flat_bytes, joined_hashes, lean, mix, run_positions, shared_folder, starts_of, sweep, word_hashes, word_spans, written

#: Words per shingle, and bits within which fingerprints are candidates before the prefixes are read.
WIDTH, BITS = 5, 3
#: Texts that frequent shingles are counted on, the count from which one is frequent, and how many are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 5000, 4, 100_000
#: Tasks that the rows of a frequent shingle are dealt to.
SPREAD = 64
#: Rows of a shingle that are paired in one task; larger groups are dealt out by pairs of buckets.
GROUP = 20_000
#: Pairs that are looked at together.
PAIRS = 1 << 18
#: Longs in a set's bitmap at least.
LEAST_LONGS = 4
_EMPTY = np.uint64(0x51AFD7ED558CCD6D)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in order, how many each has); A-Z are lower-cased. Fewer words: one shingle of them all."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, bounds = word_spans(data, offsets)
    h, n = word_hashes(data, starts, ends), np.diff(bounds)
    text, at = run_positions(np.maximum(n - width + 1, 0), bounds[:-1])
    values, texts = [joined_hashes(h, width)[at]], [text]
    for m in range(1, width):
        short = np.flatnonzero(n == m)
        if len(short):
            whole = joined_hashes(h[bounds[short][:, None] + np.arange(m)].ravel(), m)[::m]
            values.append(mix(whole + np.uint64(m)))
            texts.append(short)
    v, t = np.concatenate(values), np.concatenate(texts)
    order = np.lexsort((v, t))
    v, t = v[order], t[order]
    new = starts_of(v, t)
    return v[new], np.bincount(t[new], minlength=len(n))


def names(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    out = np.full(len(counts), _EMPTY)
    full = np.flatnonzero(counts)
    if len(full):
        sums = np.add.reduceat(mix(values ^ _EMPTY), (np.cumsum(counts) - counts)[full])
        out[full] = mix(sums + counts[full].astype(np.uint64))
    return out


def bitmaps(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longs of all sets' bitmaps on end, how many each has), with a bit for each shingle and about four bits a shingle.

    A bit that one set has and another lacks stands for a shingle at least that the other lacks. Lengths are powers of two, so the longer of two
    bitmaps is folded to the other's length by OR of its halves.
    """
    longs = np.maximum(LEAST_LONGS, 1 << np.ceil(np.log2(np.maximum(counts / 16, 1))).astype(np.int64))
    out, begin = np.zeros(int(longs.sum()), np.uint64), np.cumsum(longs) - longs
    own = np.repeat(np.arange(len(counts)), counts)
    place = mix(values + _EMPTY) % (longs[own] * 64).astype(np.uint64)
    np.bitwise_or.at(out, begin[own] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out, longs


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _named(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_hash, node, fp, n, bits``: each row's set, its SimHash, size and bitmap."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 2, 2 << 20):
            v, n = shingles(*flat_bytes(batch.column(2)), width)
            bits, longs = bitmaps(v, n)
            bits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(longs)).astype(np.int32)), pa.array(bits.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names(v, n).view(np.int64)), pa.array(simhash.majority(v, n).view(np.int64)), pa.array(n.astype(np.int32)), bits], names=["doc_id", "text_hash", "node", "fp", "n", "bits"])

    return docs.mapInArrow(lean(run), "doc_id long, text_hash long, node long, fp long, n int, bits array<long>")


def _frequent(docs: DataFrame, total: int, width: int) -> np.ndarray:
    """Shingles often seen in a bounded sample of texts, the rarest first."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 0, 2 << 20):
            v, n = shingles(*flat_bytes(batch.column(0)), width)
            _, first = np.unique(names(v, n), return_index=True)
            text = np.repeat(np.arange(len(n)), n)
            key, count = np.unique(v[np.isin(text, first)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["key", "n"])

    chosen = docs.filter(F.pmod("text_hash", F.lit(max(1, total // SAMPLE))) == 0).select("text")
    found = chosen.mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    return found.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toPandas()["key"].to_numpy(np.int64).view(np.uint64)[::-1]


def prefixes(docs: DataFrame, frequent: np.ndarray, width: int) -> DataFrame:
    """``key, salt, node, n, room``: of each set the first ``n // 5 + 1`` shingles: by value, then the frequent ones in their order.

    ``room`` is how many shingles the set has from this one on; ``salt`` is over 0 for frequent shingles.
    """
    by_value = np.argsort(frequent, kind="stable")
    ordered = frequent[by_value]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 0, 2 << 20):
            s, n = shingles(*flat_bytes(batch.column(0)), width)
            node = names(s, n)
            once = np.zeros(len(n), bool)
            once[np.unique(node, return_index=True)[1]] = True  # equal sets within the batch
            text = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(s), np.int64)
            if len(ordered):
                place = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                rank = np.where(ordered[place] == s, by_value[place] + 1, 0)
            order = np.lexsort((rank, text))  # stable, so by value where ranks are equal
            within = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            use = (within < (n // 5 + 1)[text]) & once[text]
            chosen, text, within = order[use], text[use], within[use]
            salt = np.where(rank[chosen] > 0, 1 + (mix(node[text]) % np.uint64(SPREAD)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(s[chosen].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(node[text].view(np.int64)), pa.array(n[text].astype(np.int32)), pa.array((n[text] - within).astype(np.int32))], names=["key", "salt", "node", "n", "room"])

    return docs.select("text").mapInArrow(lean(run), "key long, salt int, node long, n int, room int")


def _met(rows: DataFrame) -> DataFrame:
    """The rows of prefix shingles that two or more sets have, once each (and all rows of frequent ones)."""
    w = W.partitionBy("key", "salt")
    met = rows.withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w)).filter("salt > 0 or lo < hi")
    return met.groupBy("key", "node").agg(F.first("n").alias("n"), F.first("room").alias("room"))


def _fits(n: str, room: str, other_n: str, other_room: str):
    """Whether sets whose first common shingle leaves these rooms can have a similarity of 0.8: 5 c >= 4 (x + y - c) for c common ones."""
    return 9 * F.least(room, other_room) >= 4 * (F.col(n) + F.col(other_n))


def _stars(met: DataFrame, folder: str) -> DataFrame:
    """Pairs ``a, b`` of each shingle's sets with the one of them whose part from this shingle on is largest."""
    code = F.floor(F.col("room") / F.col("n") * 1_000_000) * F.lit(1 << 40) + F.pmod("node", F.lit(1 << 40))
    chief = met.withColumn("code", code).groupBy("key").agg(F.max_by("node", "code").alias("c"), F.max_by("n", "code").alias("c_n"), F.max_by("room", "code").alias("c_room"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    chief = written(chief.filter("lo < hi").drop("lo", "hi"), folder, "chiefs")  # a plain side of the join, so a shingle of many rows can be split
    return met.join(chief, "key").filter((F.col("node") != F.col("c")) & _fits("n", "room", "c_n", "c_room")).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole sets have a similarity of 0.8 or more."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return rows.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _labels(edges: DataFrame, folder: str) -> DataFrame:
    """``node, label``: the least node within two links, so all of a star have one label. Equal labels are linked; linked nodes may differ."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), folder, "least")
    near = both.join(least.withColumnRenamed("u", "v"), "v").select("u", "m").unionByName(least.select("u", "m"))
    return near.groupBy("u").agg(F.min("m").alias("label")).withColumnRenamed("u", "node")


def _all_pairs(rows: DataFrame, folder: str, group: int) -> DataFrame:
    """Pairs ``a, b`` of all nodes of a key that have other labels and may be similar, from ``key, label, node, n, room``.

    A key of more than ``group`` rows is dealt out to cells of two of its buckets each: a pair meets in one cell.
    """
    keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    keys = written(keys.select("key", F.ceil(F.col("size") / group).cast("int").alias("parts")), folder, "keys")
    rows = rows.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("own", j).cast("long") * F.col("parts") + F.greatest("own", j)))
    rows = rows.select("key", cell.alias("cell"), "label", "node", "n", "room", "own", (F.col("parts") > 1).alias("split"))

    def pairs(key: np.ndarray, cell: np.ndarray, label: np.ndarray, node: np.ndarray, n: np.ndarray, room: np.ndarray, own: np.ndarray, split: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = len(key)
        new_key = starts_of(key, cell)
        new_label = new_key | starts_of(label)
        stop = np.append(np.flatnonzero(new_key)[1:], size)[np.cumsum(new_key) - 1]
        start = np.append(np.flatnonzero(new_label)[1:], size)[np.cumsum(new_label) - 1]
        first = own[np.flatnonzero(new_key)[np.cumsum(new_key) - 1]]
        mixed = np.bitwise_or.reduceat(own != first, np.flatnonzero(new_key))[np.cumsum(new_key) - 1] if size else split
        ends = np.cumsum(stop - start)
        for lo in range(0, int(ends[-1]), PAIRS):
            at = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
            i = np.searchsorted(ends, at, side="right")
            j = start[i] + at - (ends[i] - (stop - start)[i])
            near = (9 * np.minimum(room[i], room[j]) >= 4 * (n[i] + n[j])) & ~(split[i] & mixed[i] & (own[i] == own[j]))
            if near.any():
                i, j = node[i[near]], node[j[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in rows:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(k)).astype(np.int64) for k in range(7)] + [np.asarray(batch.column(7)).astype(bool)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            change = np.flatnonzero(starts_of(held[0], held[1])[1:])
            if len(change):
                to = int(change[-1]) + 1
                yield from pairs(*[x[:to] for x in held])
                held = [x[to:] for x in held]
        if held:
            yield from pairs(*held)

    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "label").mapInArrow(lean(run), "a long, b long")


def _sets_of(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """``node, s``: the whole sets of the rows that ``places`` (``at, text_hash``) names."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 0, 2 << 20):
            v, n = shingles(*flat_bytes(batch.column(0)), width)
            offsets = np.append(0, np.cumsum(n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(names(v, n).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.view(np.int64)))], names=["node", "s"])

    rows = docs.select(_at().alias("at"), "text_hash", "text").join(places, ["at", "text_hash"], "left_semi").dropDuplicates(["at", "text_hash"])
    return rows.select("text").mapInArrow(lean(run), "node long, s array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, folder: str, number: int, width: int) -> DataFrame:
    """The pairs that are similar. Bitmaps first rule out those that lack too much; the whole sets of the others are made for this and leave again."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    # sizes that may be similar have bitmaps of one length or of twice that
    folded = lambda x, y: F.when(F.size(f"{x}_bits") <= F.size(f"{y}_bits"), F.col(f"{x}_bits")).otherwise(F.zip_with(F.slice(f"{x}_bits", 1, F.size(f"{y}_bits")), F.slice(f"{x}_bits", F.size(f"{y}_bits") + 1, F.size(f"{y}_bits")), lambda p, q: p.bitwiseOR(q)))
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, k: s + k)
    least = 4 * (F.col("a_n") + F.col("b_n"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(9 * F.least("a_n", "b_n") >= least)
    pairs = pairs.select("a", "b", "a_n", "b_n", folded("a", "b").alias("x"), folded("b", "a").alias("y"))
    pairs = pairs.filter((9 * (F.col("a_n") - lacks("x", "y")) >= least) & (9 * (F.col("b_n") - lacks("y", "x")) >= least))
    pairs = written(pairs.select("a", "b"), folder, f"near-{number}")
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    places = written(sets.join(used, "node").select("at", "text_hash"), folder, f"places-{number}")
    whole = written(_sets_of(docs, places, width), folder, f"whole-{number}")
    sweep(docs.sparkSession)
    found = written(_confirmed(pairs, whole), folder, f"edges-{number}")
    discard(docs.sparkSession, f"{folder}/whole-{number}")
    sweep(docs.sparkSession)
    return found


def _at():
    """A row's id; rows without one come last."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1))


def _linked(df: DataFrame, id_col: str, text_col: str, width: int, group: int) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """(each row's set, the distinct sets and a row that has each, ``node, root`` of linked sets, the folder of all these tables)."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    docs = _texts(df, id_col, text_col)
    rows = written(_named(docs, width), folder, "rows")
    sets = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct(_at().alias("at"), "text_hash")).alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("bits").alias("bits"))
    sets = written(sets.select("node", "least", "first.at", "first.text_hash", "fp", "n", "bits"), folder, "sets")
    met = written(_met(prefixes(docs, _frequent(docs, rows.count(), width), width)), folder, "met")
    sweep(spark)

    # pairs that fingerprints show, and those of each shingle's sets with one of them
    same = written(sets.groupBy("fp").agg(F.min("node").alias("one")), folder, "same")
    near = simhash.links(same.select("fp"), folder, BITS)
    first = near.join(same.withColumnRenamed("fp", "a"), "a").select("b", F.col("one").alias("x")).join(same.withColumnRenamed("fp", "b"), "b").select(F.col("x").alias("a"), F.col("one").alias("b"))
    first = first.unionByName(sets.join(same, "fp").select(F.col("one").alias("a"), F.col("node").alias("b")))
    first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").unionByName(_stars(met, folder))
    first = written(first.distinct(), folder, "pairs-0")

    edges = _verified(first, docs, sets, folder, 0, width)

    # all pairs of a shingle that are not linked yet
    labelled = written(met.join(_labels(edges, folder), "node", "left").withColumn("label", F.coalesce("label", "node")), folder, "labelled")
    second = written(_all_pairs(labelled, folder, group).distinct(), folder, "pairs-1")
    edges = edges.unionByName(_verified(second, docs, sets, folder, 1, width))
    roots = simhash.components(edges, folder)
    for name in ("met", "labelled", "chiefs", "pairs-0", "pairs-1"):
        discard(spark, f"{folder}/{name}")
    sweep(spark)
    return rows.select("doc_id", "node"), sets.select("node", "least", "at", "text_hash"), roots, folder


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """``doc_id, component_id`` of every row; documents link at a Jaccard similarity of 0.8 or more of their shingle sets.

    ``component_id`` is the smallest id reachable over any number of links. Null and empty texts and texts without words
    have the empty set and link to each other alone, texts of fewer than ``width`` words have one shingle. Null and repeated ids
    are as in ``simhash.near_duplicates``. An empty table gives an empty one; other columns are not read; very long texts are read whole.
    """
    rows, sets, roots, folder = _linked(df, id_col, text_col, width, group)
    return rows.join(simhash.least_of_components(sets.select("node", "least"), roots, folder, "node"), "node").select("doc_id", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Of each component of ``near_copies`` one row of ``df``: that with the smallest id, and of texts that share it that of the smallest hash.

    Rows without an id stand behind all others. Of rows that repeat an id and a text one stays. All columns stay, whatever their names.
    """
    _, sets, roots, folder = _linked(df, id_col, text_col, width, group)
    member = sets.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("at", "text_hash")).alias("one"))
    stay = written(member.select("one.at", "one.text_hash"), folder, "stay")
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("at"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"), F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias("row"))
    return rows.join(stay, ["at", "text_hash"], "left_semi").dropDuplicates(["at", "text_hash"]).select(*[F.col(f"row.`{x}`") for x in df.columns])
