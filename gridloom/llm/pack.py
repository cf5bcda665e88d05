"""Packing of token sequences: best-fit decreasing over a segment tree of remaining capacities.

Every task packs what it reads, so nothing is shuffled and no group meets in one place: a sequence's number holds
the task's number, and a task that runs again makes the whole of its sequences again. Only chunks of a bounded
number of tokens are held at a time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import byte_letters
from gridloom.llm.common import KEPT, batches, lean, texts

WINDOW = 2048
#: Tokens that a task holds before it packs them.
CHUNK_TOKENS = 12 << 20
#: A task's sequences are numbered from its number times this.
PER_TASK = 1 << 36


class OpenWindows:
    """Windows by remaining capacity, in a segment tree over capacities 0 to ``size`` that holds counts.

    ``tightest(n)`` walks to the smallest capacity of at least n that an open window has.
    """

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        k = capacity + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def tightest(self, n: int) -> tuple[int, int] | None:
        """Takes out (capacity, window), or gives None if no open window has room for n."""
        count, k = self.count, n + self.leaves
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return capacity, self.windows[capacity].pop()


def fitted(lengths: np.ndarray, size: int) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Best-fit decreasing: each piece, the longest first, goes to the tightest open window; (windows, the room left in each)."""
    tree, windows, room = OpenWindows(size), [], []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        found = tree.tightest(n)
        if found is None:
            capacity, window = size, len(windows)
            windows.append([])
            room.append(size)
        else:
            capacity, window = found
        windows[window].append((piece, 0, n))
        room[window] = capacity - n
        if capacity > n:
            tree.put(capacity - n, window)
    return windows, room


def best_fit(lengths: np.ndarray, size: int) -> list[list[tuple[int, int, int]]]:
    """Packs pieces of 1 to ``size`` tokens: for each window its (piece, from, to), the whole of each piece once.

    Best-fit decreasing first. What stays open is then closed: the emptiest windows are taken apart, and their
    pieces, cut where need be, fill the gaps of the fuller ones, so that one window at most keeps a gap.
    """
    windows, room = fitted(lengths, size)
    gaps = sorted((w for w in range(len(windows)) if room[w]), key=lambda w: (room[w], w))
    lo, hi = 0, len(gaps) - 1
    while lo < hi:
        into, source = windows[gaps[lo]], windows[gaps[hi]]
        while room[gaps[lo]] and source:
            piece, start, end = source.pop()
            n = min(end - start, room[gaps[lo]])
            into.append((piece, start, start + n))
            room[gaps[lo]] -= n
            room[gaps[hi]] += end - start
            if start + n < end:
                source.append((piece, start + n, end))
                room[gaps[hi]] -= end - start - n
        lo += not room[gaps[lo]]
        hi -= not source
    return [x for x in windows if x]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizers library's reading of the file, and a merge table of the same vocabulary for plain text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {x: b for b, x in enumerate(byte_letters())}
    ranks = {bytes(byte[x] for x in token): i for token, i in spec["model"]["vocab"].items()}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(path), plain, [x["content"] for x in spec["added_tokens"]]


KEPT["pack"] = _tokenizer.cache_clear
#: A run of white space, or of anything else, that is longer than any word.
_LONG_RUN = re.compile(r"\s{16384}|\S{16384}")


class Tokens:
    """Ids of whole texts as little-endian unsigned 32-bit values, as the tokenizers library gives them.

    Texts that spell a special token, or hold a run of one kind of characters too long for tiktoken's expressions, go to
    that library itself, all others through the same merges in tiktoken, which takes a quarter of the time; tests
    hold the two against each other.
    """

    #: Characters from which a text may hold such a run.
    LONG = 1 << 14

    def __init__(self, path: str):
        self.library, self.plain, self.specials = _tokenizer(path)

    @classmethod
    def _has_long_run(cls, text: str) -> bool:
        return len(text) >= cls.LONG and _LONG_RUN.search(text) is not None

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.specials) or self._has_long_run(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.plain.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4").tobytes() if text else b""


def pack(df: DataFrame, path: str, end_id: int = 1, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Packs every row's ids, with ``end_id`` after them, into sequences of at most ``size`` tokens.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked,
    ``ids``. Overlong documents are first cut into full windows, the rest is packed by ``best_fit``.

    A null text is empty and gives its end alone. Null and repeated ids are kept: each row is a document of its
    own. An empty table gives no sequences; other columns are not read. A very long text is held whole.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) * PER_TASK
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []
        rests: list[tuple] = []
        held = 0

        def piece(doc, start: int, data: bytes, total: int, sequence: int, offset: int) -> None:
            out.append((doc, start, len(data) // 4, zlib.crc32(data), total, sequence, offset, *([np.frombuffer(data, "<u4").astype(np.int32)] if with_ids else [])))

        def made() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return batch

        def close() -> None:
            nonlocal number, held
            for window in best_fit(np.array([len(x[2]) // 4 for x in rests], np.int64), size):
                offset = 0
                for k, start, to in window:
                    doc, before, data, total = rests[k]
                    piece(doc, before + start, data[4 * start : 4 * to], total, number, offset)
                    offset += to - start
                number += 1
            rests.clear()
            held = 0

        for batch in batches(rows, 1):
            for doc, data in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                data = tokens.ids(data.decode("utf-8")) + end
                total = len(data) // 4
                whole = total - total % size
                for start in range(0, whole, size):
                    piece(doc, start, data[4 * start : 4 * (start + size)], total, number, 0)
                    number += 1
                if whole < total:
                    rests.append((doc, whole, data[4 * whole :], total))
                    held += total - whole
                if held >= chunk_tokens:
                    close()
                if len(out) >= 20_000:
                    yield made()
        if rests:
            close()
        if out:
            yield made()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, "pack"), schema)
