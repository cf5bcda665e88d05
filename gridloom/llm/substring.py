"""Removal of repeated word passages by relative Lempel-Ziv parsing against indexed reference blocks.

A document's windows of 13 words are cut into segments: neighbouring windows whose smallest 4-word hash (the anchor) is
the same. Equal windows have equal anchors, so a segment need be held only against the segments of its own anchor: these
are its reference block. Anchors of one document alone leave first, as rows of four numbers; for the rest the
words are sent, as their 64-bit hashes.

A block indexes its segments by a suffix array over their words, made by ranking windows of 1, 2, 4, 8, 13 and more words
exactly, so words and no shortened hashes decide. Each segment is then parsed greedily: from the first place
where a window stands in an earlier document, the longest match in any earlier document becomes a factor; the parse goes
on at its boundary, where the windows that reach over the factor's end are looked up one by one.

Within a batch, segments whose words are equal are settled at once against the smallest id, so passages that many
documents share leave a batch once. Anchors that a sample of documents shows to be frequent (this steers only the
layout) are dealt by window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import batches, flat_bytes, joined_hashes, lean, mix, run_positions, shared_folder, starts_of, sweep, texts, word_hashes, word_spans, written

WINDOW = 13
ANCHOR = 4
#: Text that is parsed at a time, and words of whole keys that are indexed together, about.
_BATCH, BLOCK_WORDS = 2 << 20, 1 << 18
#: Windows of one segment at most, and tasks that a frequent anchor's segments are dealt to.
_MOST, SPREAD = (1 << 24) - 1, 64
#: Documents of the sample that finds frequent anchors: so many, or this part of all if that is more.
SAMPLE, SAMPLE_PART, FREQUENT = 4000, 0.001, 60


class Windows:
    """Of texts on end: the words' hashes ``h`` and first words ``bounds``, and each window's text, first word within it and anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.bounds = word_spans(data, offsets)
        self.h = word_hashes(data, starts, ends)
        counts = np.maximum(np.diff(self.bounds) - WINDOW + 1, 0)
        self.text, at = run_positions(counts, self.bounds[:-1])
        self.within = at - self.bounds[:-1][self.text]
        least = joined_hashes(self.h, ANCHOR)
        for step in (1, 2, 4):  # over eight neighbours, then over the ten of a window
            least = np.minimum(least[: max(len(least) - step, 0)], least[step:])
        self.anchor = np.minimum(least[at], least[at + 2]) if len(at) else np.zeros(0, np.uint64)

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """(first window, number of windows) of each segment."""
        first = np.flatnonzero(starts_of(self.text, self.anchor)) if len(self.text) else np.zeros(0, np.int64)
        return first, np.diff(np.append(first, len(self.text)))


def _frequent(rows: DataFrame) -> np.ndarray:
    """Anchors that many documents of a sample hold."""
    part = min(1.0, max(SAMPLE / max(rows.count(), 1), SAMPLE_PART))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 0, _BATCH):
            w = Windows(*flat_bytes(batch.column(0)))
            order = np.lexsort((w.text, w.anchor))
            once = starts_of(w.anchor[order], w.text[order])
            anchor, count = np.unique(w.anchor[order][once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(count.astype(np.int64))], names=["a", "n"])

    found = rows.sample(False, part, 7).select("text").mapInArrow(lean(run), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(np.array([r["a"] for r in found.orderBy(F.desc("n"), "a").limit(50_000).collect()], np.int64).view(np.uint64))


def _among(anchor: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor if len(hot) else np.zeros(len(anchor), bool)


def _anchored(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """``anchor, salt, doc_id, text_hash, place`` of each segment; its place holds the first window (times 2**24) and how many there are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 2, _BATCH):
            docs, hashes = (np.asarray(batch.column(k)) for k in (0, 1))
            w = Windows(*flat_bytes(batch.column(2)))
            first, count = w.segments()
            # a segment of 2**24 windows or more goes on as several
            segment, part = run_positions(-(-count // _MOST), np.zeros(len(count), np.int64))
            place = (w.within[first][segment] + part * _MOST) << 24 | np.minimum(count[segment] - part * _MOST, _MOST)
            doc, anchor = w.text[first][segment], w.anchor[first][segment]
            salt = np.where(_among(anchor, hot), 1 + (mix(docs[doc].astype(np.uint64)) % np.uint64(SPREAD)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(docs[doc]), pa.array(hashes[doc]), pa.array(place)], names=["anchor", "salt", "doc_id", "text_hash", "place"])

    return rows.mapInArrow(lean(run), "anchor long, salt int, doc_id long, text_hash long, place long")


def _shared(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """``doc_id, text_hash, places`` of the segments whose anchor stands in two or more documents (or is a frequent one)."""
    w = W.partitionBy("anchor", "salt")
    met = _anchored(rows, hot).withColumn("lo", F.min("doc_id").over(w)).withColumn("hi", F.max("doc_id").over(w)).filter("salt > 0 or lo < hi")
    return met.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def _sent(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """``key, doc_id, text_hash, start, words`` of the segments named in ``places``, and as rows without words (but with ``n_words,
    ref_doc, ref_start``) the factors that a batch settles. ``words`` are hashes; frequent anchors' windows are rows of their own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 2, _BATCH):
            docs, hashes = (np.asarray(batch.column(k)) for k in (0, 1))
            w = Windows(*flat_bytes(batch.column(2)))
            if not len(w.text):
                continue
            places, owner = np.asarray(batch.column(3).flatten()), np.repeat(np.arange(len(docs)), np.diff(np.asarray(batch.column(3).offsets)))
            n = np.diff(w.bounds) - WINDOW + 1
            base = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
            edge = np.zeros(len(w.text) + 1, np.int64)
            begin = base[owner] + (places >> 24)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + (places & _MOST), -1)
            use = np.cumsum(edge[:-1]) > 0
            alone = _among(w.anchor, hot)
            new = starts_of(w.text, w.anchor) | alone
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(w.text)))
            chosen = use[first]
            first, count = first[chosen], count[chosen]
            if not len(first):
                continue
            doc, start, size = w.text[first], w.within[first], count + WINDOW - 1
            word0 = w.bounds[:-1][doc] + start
            row, at = run_positions(size, word0)
            flat = w.h[at]
            ends = np.cumsum(size)
            sums = mix(np.add.reduceat(mix(flat + np.uint64(1)) * ((at - word0[row]).astype(np.uint64) * np.uint64(2) + np.uint64(1)), ends - size) + size.astype(np.uint64))
            key = np.where(alone[first], sums, w.anchor[first])
            # segments whose words are equal: all but those of the smallest id are settled here
            order = np.lexsort((start, docs[doc], sums))
            lead = starts_of(sums[order])
            chief = np.empty(len(order), np.int64)
            chief[order] = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            gone = np.flatnonzero((docs[doc] > docs[doc[chief]]) & (size == size[chief]))
            if len(gone):  # word by word
                r, p = run_positions(size[gone], (ends - size)[gone])
                q = run_positions(size[gone], (ends - size)[chief[gone]])[1]
                gone = gone[np.bincount(r, flat[p] != flat[q], len(gone)) == 0]
            ref = chief[gone]
            stay = np.ones(len(first), bool)
            stay[gone] = False
            stay = np.flatnonzero(stay)
            sent = pa.array([x.tobytes() for x in np.split(flat, ends[:-1])], pa.binary()).take(pa.array(stay))
            none = pa.nulls(len(stay), pa.int64())
            names = ["key", "doc_id", "text_hash", "start", "words", "n_words", "ref_doc", "ref_start"]
            columns = [pa.array(key[stay].view(np.int64)), pa.array(docs[doc[stay]]), pa.array(hashes[doc[stay]]), pa.array(start[stay]), sent, none, none, none]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if len(gone):
                columns = [pa.array(mix(docs[doc[gone]].astype(np.uint64)).view(np.int64)), pa.array(docs[doc[gone]]), pa.array(hashes[doc[gone]]), pa.array(start[gone]), pa.nulls(len(gone), pa.binary()), pa.array(size[gone]), pa.array(docs[doc[ref]]), pa.array(start[ref])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("doc_id", "text_hash", "text", "places").mapInArrow(lean(run), "key long, doc_id long, text_hash long, start long, words binary, n_words long, ref_doc long, ref_start long")


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows in the order of their columns."""
    order = np.lexsort(columns[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(starts_of(*[x[order] for x in columns])) - 1
    return out


def _nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value the nearest place before and after it that holds a smaller one; -1 and the length where there is none."""
    n = len(values)
    table, step = [values], 1
    while 2 * step <= n:  # minima of 2, 4, ... values from each place
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        step *= 2
    before, after = np.arange(n) - 1, np.arange(n) + 1
    for k in range(len(table) - 1, -1, -1):
        step, least = 1 << k, table[k]
        go = np.flatnonzero(before - step + 1 >= 0)
        go = go[least[before[go] - step + 1] >= values[go]]
        before[go] -= step
        go = np.flatnonzero(after + step <= n)
        go = go[least[after[go]] >= values[go]]
        after[go] += step
    return before, after


class Block:
    """Segments of words (64-bit hashes ``words`` on end, ``size`` of each), in a suffix array over their windows."""

    def __init__(self, words: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray):
        self.count = size - WINDOW + 1
        self.doc, self.start = doc, start
        self.row, at = run_positions(self.count, np.cumsum(size) - size)
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
        for step in (1, 2, 4, 5):  # exact ranks of 2, 4, 8 and 13 words
            rank = _ranks(rank[: len(rank) - step], rank[step:])
        self.window = rank[at]
        self.first = np.cumsum(self.count) - self.count
        self.left = self.count[self.row] - (np.arange(len(at)) - self.first[self.row])
        # longer runs of windows within a segment, by doubling: the last ranks sort all suffixes
        self.levels = [self.window + 1]
        while (1 << (len(self.levels) - 1)) < (self.count.max() if len(self.count) else 0):
            step, now = 1 << (len(self.levels) - 1), self.levels[-1]
            later = np.zeros(len(now), np.int64)
            inside = np.flatnonzero(self.left > step)
            later[inside] = now[inside + step]
            self.levels.append(_ranks(now, later) + 1)
        self.order = np.argsort(self.levels[-1], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many windows on end are equal from the windows a and b on, within their segments."""
        most, out = np.minimum(self.left[a], self.left[b]), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            go = np.flatnonzero(out + (1 << k) <= most)
            go = go[self.levels[k][a[go] + out[go]] == self.levels[k][b[go] + out[go]]]
            out[go] += 1 << k
        return out

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window the longest match in an earlier document: (its number of windows, or 0; where it begins)."""
        own = self.doc[self.row]
        length, ref = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for near in _nearest_smaller(own[self.order]):
            at = np.flatnonzero((near >= 0) & (near < len(near)))
            here, there = self.order[at], self.order[near[at]]
            same = self.window[here] == self.window[there]
            here, there = here[same], there[same]
            n = self.common(here, there)
            better = (n > length[here]) | (n == length[here]) & (own[there] < own[ref[here]])
            length[here[better]], ref[here[better]] = n[better], there[better]
        return length, ref

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window that a factor starts at, its number of windows, the window that it is laid on; segments that hold nothing new)."""
        length, ref = self.longest()
        size, place = len(length), np.arange(len(length))
        following = np.append(np.minimum.accumulate(np.where(length > 0, place, size)[::-1])[::-1], size)  # the next window with a match
        now, out = following[self.first], []
        end = self.first + self.count
        segment = np.arange(len(end))
        while True:
            go = now < end[segment]
            segment, now = segment[go], now[go]
            if not len(now):
                break
            out.append(now)
            now = following[now + length[now]]  # from here on windows reach over the factor's end
        found = np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)
        known = np.bincount(self.row, length > 0, len(self.count)) == self.count
        return found, length[found], ref[found], known


KINDS = ("doc_id", "text_hash", "start", "n_words", "ref_doc", "ref_start")


def _parsed(sent: DataFrame, block_words: int) -> DataFrame:
    """Factors: all segments of a key meet in one task, in order of documents, and whole keys make blocks of about ``block_words`` words.

    Of a key with more words than that, segments that hold nothing new are no longer needed as references and leave.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        words: list[bytes] = []
        total = 0

        def parse() -> tuple[pa.RecordBatch, np.ndarray]:
            key, doc, text_hash, start = (np.concatenate(x) for x in zip(*held, strict=True))
            size = np.array([*map(len, words)], np.int64) // 8
            block = Block(np.frombuffer(b"".join(words), np.uint64), size, doc, start)
            at, n, ref, known = block.factors()
            row, other = block.row[at], block.row[ref]
            found = (doc[row], text_hash[row], start[row] + at - block.first[row], n + WINDOW - 1, doc[other], start[other] + ref - block.first[other])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[*KINDS]), known

        def drop(to: int, keep: np.ndarray) -> None:
            """Forgets the first ``to`` segments but those marked."""
            nonlocal total
            stay = np.append(keep, np.ones(len(words) - to, bool))
            columns = [np.concatenate(x)[stay] for x in zip(*held, strict=True)]
            words[:] = [words[k] for k in np.flatnonzero(stay).tolist()]
            held[:] = [tuple(columns)]
            total = sum(map(len, words)) // 8

        for whole in it:
            if not whole.num_rows:
                continue
            settled = whole.filter(whole.column(4).is_null())
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([settled.column(k) for k in (1, 2, 3, 5, 6, 7)], names=[*KINDS])
            whole = whole.filter(whole.column(4).is_valid())
            if not whole.num_rows:
                continue
            for batch in batches(iter([whole]), 4, 8 * block_words):
                held.append(tuple(np.asarray(batch.column(k)) for k in range(4)))
                words += batch.column(4).to_pylist()
                total += sum(map(len, batch.column(4).to_pylist())) // 8
                if total < block_words:
                    continue
                key = np.concatenate([x[0] for x in held])
                out, known = parse()
                yield out
                drop(len(key), ~known & (key == key[-1]))  # the last key may go on
        if held and words:
            yield parse()[0]

    return sent.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(lean(run), ", ".join(f"{x} long" for x in KINDS))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def factors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Factors of 13 and more words: ``doc_id, text_hash, start, n_words, ref_doc, ref_start`` (in words from 0).

    The words of a factor stand in ``ref_doc``, which has a smaller id. Rows with a null id are neither parsed nor
    referred to. Factors of one document may overlap, by the windows over their ends and where segments do; their
    union is what is repeated. A factor may come several times. They are written to the shared folder.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    rows = _keyed(df, id_col, text_col).filter("doc_id is not null")
    hot = _frequent(rows)
    places = written(_shared(rows, hot), folder, "places")
    sweep(spark)
    found = written(_parsed(_sent(rows.join(places, ["doc_id", "text_hash"]), hot), block_words), folder, "factors")
    sweep(spark)
    return found


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Takes out every word that a repeated window covers, as judged on the input.

    Returns a row per row: ``doc_id, n_words, n_removed`` and then ``kept_sha256`` (of the kept words joined by one
    space) if ``digest``, else ``kept_text``: the text without the removed words and the white space after them,
    unchanged if none is removed; then the columns named in ``keep``.

    Null and empty texts have no words. Rows with a null id lose nothing and cost others nothing. Rows that share an
    id are not earlier than each other. Of equal texts the smallest id keeps its words. An empty table gives an empty
    one. Columns of ``df`` may have any names; only those asked for are read. Very long texts are parsed whole.
    """
    found = factors(df, id_col, text_col).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n_words")).alias("spans"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(x).alias(f"c{k}") for k, x in enumerate(keep)]).alias("rest"))
    rows = rows.join(found, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans", "rest")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1, _BATCH):
            n_words, n_removed, out = [], [], []
            spans = batch.column(2)
            flat, offsets = spans.flatten(), np.asarray(spans.offsets)
            offsets = offsets - offsets[0]
            begin, length = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            for k, text in enumerate(texts(batch.column(1))):
                words = text.split()
                n_words.append(len(words))
                a, b = offsets[k], offsets[k + 1]
                keep_ = None
                if a < b:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, begin[a:b], 1)
                    np.add.at(edge, begin[a:b] + length[a:b], -1)
                    keep_ = np.cumsum(edge[:-1]) == 0
                n_removed.append(0 if keep_ is None else int((~keep_).sum()))
                if digest:
                    kept = words if keep_ is None else [words[i] for i in np.flatnonzero(keep_).tolist()]
                    out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                elif keep_ is None:
                    out.append(text.decode("utf-8"))
                else:
                    starts, *_ = word_spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                    ends = [*starts[1:].tolist(), len(text)]
                    out.append((text[: starts[0]] + b"".join(text[s:e] for s, e, x in zip(starts.tolist(), ends, keep_.tolist(), strict=True) if x)).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string()), batch.column(3)], names=["doc_id", "n_words", "n_removed", "kept", "rest"])

    rest = rows.schema["rest"].dataType.simpleString()
    out = rows.mapInArrow(lean(run), f"doc_id long, n_words long, n_removed long, kept string, rest {rest}")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digest else "kept_text"), *[F.col(f"rest.c{k}").alias(x) for k, x in enumerate(keep)])
