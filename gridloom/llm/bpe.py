"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the pairs of neighbours are looked up by binary
search over the sorted pair keys, each word's lowest rank is found by a segmented minimum, all its occurrences
merge from left to right, and words without a known pair leave; after the first round only pairs beside a merge are
looked up. As every merge makes a symbol of its own and
later merges have higher ranks, this gives what merging one pair at a time gives.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import KEPT, batches, lean, texts

_NONE = np.iinfo(np.int32).max
#: White space as the tokenizer files' expressions know it; unlike Python's it lacks \x1c to \x1f.
_WHITE = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"\x00|'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}\x00]+")
_ZERO_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encodes and decodes with a tokenizer file of the word-end kind (NFC, lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int32)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.numbers = [*map(str, range(len(self.tokens)))]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = np.int64(len(self.tokens))
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def look(self, symbols: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
        """Puts the ranks of the pairs that begin at ``places`` into ``ranks``."""
        keys = symbols[places] * self.size + symbols[places + 1]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        ranks[places] = np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and how many each has; no word is empty."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.array([*map(len, words)], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        last = np.zeros(len(symbols), bool)  # a word's last symbol has no neighbour
        last[ends] = True
        ranks = np.full(len(symbols), _NONE, np.int32)
        self.look(symbols, np.flatnonzero(~last), ranks)
        names = np.arange(len(words))
        done = []
        while True:
            least = np.minimum.reduceat(ranks, np.cumsum(lengths) - lengths)
            over = least == _NONE
            if over.any():
                keep = np.repeat(~over, lengths)
                done.append((names[over], lengths[over], symbols[~keep]))
                symbols, ranks, last, names, lengths, least = symbols[keep], ranks[keep], last[keep], names[~over], lengths[~over], least[~over]
                if not len(names):
                    break
            chosen = (ranks == np.repeat(least, lengths)).nonzero()[0]
            # in a run of overlapping pairs every second one merges
            first = np.ones(len(chosen), bool)
            first[1:] = np.diff(chosen) > 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            symbols[chosen] = self.merged[ranks[chosen]]
            ranks[chosen] = _NONE
            last[chosen] = last[chosen + 1]
            stay = np.ones(len(symbols), bool)
            stay[chosen + 1] = False
            starts = np.cumsum(lengths) - lengths
            symbols, ranks, last, lengths = symbols[stay], ranks[stay], last[stay], np.add.reduceat(stay, starts, dtype=np.int64)
            at = chosen - np.arange(len(chosen))  # where the merged symbols stand now
            near = np.concatenate([at, at[at > 0] - 1])
            self.look(symbols, near[~last[near]], ranks)
        names, counts, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        out = np.zeros(len(words), np.int64)
        out[names] = counts
        starts = (np.cumsum(out) - out)[names]
        flat = np.zeros(len(ids), np.int64)
        flat[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
        return flat, out

    @staticmethod
    def normal(text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # each capital by itself, final or not

    def split(self, chunks: list[bytes]) -> list[list[str]]:
        """The words of each chunk, special tokens as they are. A chunk has no ASCII white space, so no rule reaches over its ends."""
        out: list[list[str]] = [[] for _ in chunks]
        strings = [""] * len(chunks)
        for k, x in enumerate(chunks):
            if x.isalpha():  # of ASCII letters alone
                out[k] = [x.lower().decode()]
            else:
                strings[k] = x.decode("utf-8")
        special = {k for k, x in enumerate(strings) if "\0" in x or "<|" in x and self.cut and self.cut.search(x)}
        plain = [k for k, x in enumerate(strings) if x and k not in special]
        found = iter(_SPLIT.findall(self.normal("\0".join(strings[k] for k in plain) + "\0")))
        for k in plain:
            out[k] = [*iter(found.__next__, "\0")]
        for k in special:
            for part in self.cut.split(strings[k]) if self.cut else [strings[k]]:
                out[k] += [part] if part in self.specials else _ZERO_SPLIT.findall(self.normal(part))
        return out

    def spelled(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Decimal ids and token texts of each word, joined by spaces."""
        flat, counts = self.merge([x.encode() for x in words])
        ids = flat.tolist()
        numbers, texts_ = [*map(self.numbers.__getitem__, ids)], [*map(self.tokens.__getitem__, ids)]
        ends = np.cumsum(counts).tolist()
        spans = [*zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        return [" ".join(numbers[a:b]) for a, b in spans], [" ".join(texts_[a:b]) for a, b in spans]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, as the file names no decoder; unknown ids give nothing."""
        return " ".join(self.tokens[i] for i in ids if 0 <= i < self.size and self.tokens[i])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


#: What chunks give, by tokenizer file; a worker process keeps it from task to task.
_SEEN: dict[str, tuple[dict[bytes, tuple[str, str]], int]] = {}


def _forget() -> None:
    _SEEN.clear()
    load.cache_clear()


KEPT["bpe"] = _forget
#: Bytes that a remembered chunk takes besides its characters.
_ENTRY = 320


class Encoder:
    """Whole texts to ids and back; remembers what chunks give, while these and what they give hold ``most`` bytes."""

    #: Chunks of more bytes are not remembered beyond their batch.
    LONG = 64

    def __init__(self, path: str, most: int = 96 << 20):
        self.path, self.model, self.most = path, load(path), most
        self.seen, self.held = _SEEN.setdefault(path, ({}, 0))

    def learn(self, chunked: list[list[bytes]]) -> dict[bytes, tuple[str, str]]:
        """What the chunks give that are not remembered, for this batch alone or from now on."""
        every = set().union(*chunked)
        if self.held > self.most:
            self.seen, self.held = {}, 0
        new = [*every.difference(self.seen)]
        split = self.model.split(new)
        words = [*set().union(*split) - self.model.specials.keys()]
        known = dict(zip(words, zip(*self.model.spelled(words), strict=True), strict=True)) | {x: (str(i), x) for x, i in self.model.specials.items()}
        long = {}
        for chunk, one in zip(new, split, strict=True):
            if len(one) == 1:
                found = known[one[0]]
            else:
                found = (" ".join([known[x][0] for x in one]), " ".join([known[x][1] for x in one]))
            if len(chunk) > self.LONG:
                long[chunk] = found
            else:
                self.seen[chunk] = found
                self.held += len(chunk) + len(found[0]) + len(found[1]) + _ENTRY
        _SEEN[self.path] = (self.seen, self.held)
        return long

    def ids_and_text(self, chunked: list[list[bytes]]) -> Iterator[tuple[str, str]]:
        """For each text the decimal ids joined by spaces, and the decoded text."""
        long = self.learn(chunked)
        for chunks in chunked:
            try:
                pairs = [*map(self.seen.__getitem__, chunks)]
            except KeyError:
                pairs = [self.seen.get(x) or long[x] for x in chunks]
            ids, out = [*map(itemgetter(0), pairs)], [*map(itemgetter(1), pairs)]
            if "" in ids:  # white space beyond ASCII, or what gives no token
                ids, out = [x for x in ids if x], [x for x in out if x]
            yield " ".join(ids), " ".join(out)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encodes every whole text and decodes the ids again; one row per row of ``df``.

    ``outputs`` may name ``ids`` (array of int), ``decoded``, ``ids_sha256`` and ``decoded_sha256`` (digests of the
    decimal ids joined by spaces and of the decoded UTF-8 text). Returns ``doc_id, n_tokens`` and those.

    Null and empty texts give no ids and an empty decoded text; the id may be null or repeat, as each row is
    encoded by itself; other columns of ``df`` are not read, whatever their names; an empty table gives an empty
    one. A text is never cut: it is held whole, and a batch of texts has about 4 MB or one text.
    """
    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    spark_kinds = {"ids": "array<int>"}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        gc.disable()  # what is remembered are millions of tuples, and nothing here has cycles
        try:
            for batch in batches(rows, 1):
                out: dict[str, list] = {x: [] for x in outputs}
                counts = []
                for ids, text in encoder.ids_and_text([x.split() for x in texts(batch.column(1))]):
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    if "ids" in out:
                        out["ids"].append(np.array(ids.split(), np.int32))
                    if "decoded" in out:
                        out["decoded"].append(text)
                    if "ids_sha256" in out:
                        out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *(pa.array(out[x], kinds[x]) for x in outputs)], names=["doc_id", "n_tokens", *outputs])
        finally:
            gc.enable()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, "bpe"), "doc_id long, n_tokens long" + "".join(f", {x} {spark_kinds.get(x, 'string')}" for x in outputs))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of arrays of ids, special tokens included: ``doc_id, decoded``. Null arrays give an empty text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in rows:
            texts_ = [model.decode(i for i in ids or () if i is not None) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_, pa.string())], names=["doc_id", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded string")
