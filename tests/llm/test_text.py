"""Byte-pair encoding, packing, quality rules and the classifier against the libraries themselves and plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SMALLEST
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, pack, quality, queries, rules
from gridloom.llm.common import lean

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(WORD_FILE)
TEXTS = [
    None,
    "",
    "   \n\t ",
    "Hello, World! It's the SECOND test's end.",
    "ΑΣ ΟΔΟΣ Σίσυφος İstanbul ﬁne étude  x y　z \x1c\x1d \x85q",
    "emoji 😀👩‍👩‍👧 中文字符 1234567 ½ Ⅷ",
    "a<|endoftext|>b <|startoftext|><|endoftext|> <|END|>",
    "nul\0in\0side",
    "x" * 5000,
    "don't DON'T we'll they've 'tis I'M",
    "repeat repeat repeat " * 400,
    "combining à́ ẛ̣ 한글 각",
]


def frame(spark, texts, first=0):
    """Texts with ids, and columns whose names clash with those used inside."""
    rows = [(first + k, t, "w", 7, "h") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, w string, n_words int, rest string")


def documents(limit=None):
    t = pq.read_table(f"{SMALLEST}/documents.parquet").to_pylist()
    return t[:limit] if limit else t


@pytest.fixture(scope="module")
def word_library():
    t = Tokenizer.from_file(WORD_FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_is_the_library(spark, word_library):
    texts = TEXTS + [d["text"] for d in documents()]
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, texts), WORD_FILE, outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    for k, t in enumerate(texts):
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        text = word_library.decode(ids, skip_special_tokens=False)
        r = got[k]
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), text), repr(t)[:80]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    library = LIBRARY
    ((ids, decoded),) = bpe.Encoder(WORD_FILE).ids_and_text([text.encode("utf-8", "surrogatepass").split()] if "\ud800" > max(text, default="") else [[]])
    want = library.encode(text, add_special_tokens=False).ids if "\ud800" > max(text, default="") else []
    assert [int(x) for x in ids.split()] == want and decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_edges(spark):
    assert bpe.encode(frame(spark, []), WORD_FILE).count() == 0
    same = frame(spark, ["same text", "same text"]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = bpe.encode(same, WORD_FILE).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["doc_id"] is None
    ids = spark.createDataFrame([(1, [3, None, 99999999]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(ids, WORD_FILE).collect()} == {1: bpe.load(WORD_FILE).tokens[3], 2: ""}


# --- packing -------------------------------------------------------------------------------------------------------

def packed_rightly(rows, texts, size=2048):
    library = Tokenizer.from_file(BYTE_FILE)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
    return by_seq


def test_bpe_looks_up_only_new_pairs(word_library, monkeypatch):
    words = sorted({w.lower() for d in documents(50) for w in (d["text"] or "").split() if w.isascii() and w.isalpha()}) + ["aaaaaaaaa", "x" * 300]
    looked, inner = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: (looked.append(np.size(v)), inner(a, v, *more, **named))[1])
    flat, counts = bpe.load(WORD_FILE).merge([w.encode() for w in words])
    for w, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert ids.tolist() == word_library.encode(w, add_special_tokens=False).ids, w
    letters = sum(map(len, words))
    merges = letters - len(flat)
    # all pairs once, then two beside each merge: not all pairs again in each round
    assert sum(looked) <= letters - len(words) + 2 * merges


def test_packing(spark):
    texts = TEXTS + [d["text"] for d in documents()]
    rows = pack.pack(frame(spark, texts).repartition(3), BYTE_FILE).collect()
    sequences = packed_rightly(rows, texts)
    assert sum(sum(r["length"] for r in s) < 2048 for s in sequences.values()) <= 3  # one gap per task
    small = packed_rightly(pack.pack(frame(spark, texts), BYTE_FILE, chunk_tokens=5000, with_ids=True).collect(), texts)
    assert all(len(r["ids"]) == r["length"] for s in small.values() for r in s)
    assert pack.pack(frame(spark, []), BYTE_FILE).count() == 0


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit(lengths):
    windows = pack.best_fit(np.array(lengths, np.int64), 64)
    pieces = Counter()
    for w in windows:
        assert 0 < sum(e - s for _, s, e in w) <= 64
        for k, s, e in w:
            for i in range(s, e):
                pieces[k, i] += 1
    assert pieces == Counter((k, i) for k, n in enumerate(lengths) for i in range(n))
    assert sum(sum(e - s for _, s, e in w) < 64 for w in windows) <= 1


def test_tightest_window():
    t = pack.OpenWindows(10)
    for capacity, window in ((3, 0), (7, 1), (5, 2), (5, 3)):
        t.put(capacity, window)
    assert t.tightest(4)[0] == 5 and t.tightest(4)[0] == 5 and t.tightest(4) == (7, 1) and t.tightest(4) is None and t.tightest(1) == (3, 0)


# --- quality rules -------------------------------------------------------------------------------------------------

def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, copies = set(), 0
    for x in lines:
        copies += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rules(spark):
    docs = documents()
    texts = TEXTS + ["a b c a b c d\nx y\n x y\nx y\n\n", "one two three four " * 30, "z" * 300_000, " ".join(f"w{k % 977}" for k in range(20_000))] + [d["text"] for d in docs]
    df = frame(spark, texts)
    trusted = spark.createDataFrame([(k,) for k in range(40, 90)] + [(None,), (41,)], "doc_id long")
    got = {r["doc_id"]: r for r in rules.judge(df, trusted, keep=("w", "rest", "n_words")).toDF("doc_id", "n", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept", "w", "rest", "own").collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_rules(t), repr(t)[:60]
        assert r["kept"] == (not r["base_failed"] and r["score"] >= rules.THRESHOLD)
        assert (r["w"], r["rest"], r["own"]) == ("w", "h", 7)


def test_rules_without_trust_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    df = frame(spark, [" ".join(f"w{k}" for k in range(80)), "short"])
    assert [r["kept"] for r in rules.judge(df, none).orderBy("doc_id").collect()] == [True, False]
    assert rules.judge(frame(spark, []), none).count() == 0


def test_rules_move_no_untrusted_text(spark):
    ids = [*range(0, 3000, 7), 9_000_000_001]
    df = spark.createDataFrame([(k if k % 100 else None, f"t{k}") for k in range(3000)] + [(7, "again"), (9_000_000_001, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(x,) for x in ids], "doc_id long")
    want = sorted((r["doc_id"] or -1, r["text"] or "", int(r["doc_id"] in ids)) for r in df.collect())
    before, plans = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    for threshold, bits in (("-1", rules.BITS), ("100m", rules.BITS), ("-1", 1 << 10)):  # the last with false hits
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = rules.marked(df, trusted, bits)
            assert sorted((r["doc_id"] or -1, r["text"] or "", r["trusted"] or 0) for r in got.collect()) == want
            plans.append(got._jdf.queryExecution().executedPlan().toString())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # whatever the size of the ids, one sorted join of the rows whose bit is set
    assert [p.split("== Initial Plan ==")[0].count("SortMergeJoin") for p in plans] == [1, 1, 1]


def test_rules_run_no_python(spark):
    plan = queries.op2_rules(spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_ratios_part_trusted_from_other_text(spark):
    good = [" ".join(f"good{(k * j) % 50}" for j in range(100)) for k in range(1, 40)]
    bad = [" ".join(f"bad{(k * j) % 50}" for j in range(100)) for k in range(1, 40)]
    df = frame(spark, good + bad)
    trusted = spark.createDataFrame([(k,) for k in range(39)], "doc_id long")
    score = {r["doc_id"]: r["score"] for r in rules.judge(df, trusted).collect()}
    assert min(score[k] for k in range(39)) > 0 > max(score[k] for k in range(39, 78))


def test_all_trusted_rows_count(spark):
    """Where all of many rows are trusted, no n-gram is more likely on either side."""
    df = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    assert set(rules.bucket_ratios(df, df).split(",")) == {"0"}


# --- quality classifier --------------------------------------------------------------------------------------------

def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_classifier_learns_and_is_bounded(spark):
    r = np.random.default_rng(1)
    words = {1: [f"clear{k}" for k in range(40)], 0: [f"spam{k}" for k in range(40)]}
    rows = [(k, " ".join(r.choice(words[k % 2], 60)), "w", 7, "h") for k in range(600)] + [(None, None, None, None, None), (5000, "", None, None, None), (5001, "word " * 100_000, None, None, None), (3, "clear1 clear2", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, w string, n_words int, rest string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(600)] + [(None, 1, 0), (7, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, labels, keep=("w", "rest")).collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in out)
    fresh = [x for x in out if x["doc_id"] is not None and x["doc_id"] < 600 and held_out(x["doc_id"])]
    assert all(x["held_out"] for x in fresh) and np.mean([x["predicted"] == x["doc_id"] % 2 for x in fresh]) > 0.95
    again = quality.classify(df, labels).collect()
    assert sorted((str(x["doc_id"]), x["score"]) for x in again) == sorted((str(x["doc_id"]), x["score"]) for x in out)


def test_held_out_labels_do_not_matter(spark):
    df = frame(spark, [f"alpha{k % 5} beta{k % 3} word" * 5 for k in range(60)])
    labels = [(k, k % 2) for k in range(60)]
    flipped = [(k, 1 - y if held_out(k) else y) for k, y in labels]
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(df, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, flipped))
    assert a == b


def test_classifier_with_one_class_or_nothing(spark):
    df = frame(spark, ["a b c", "d"])
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert len({r["score"] for r in quality.classify(df, one).collect()}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(df, none).collect()} == {0.5}
    assert quality.classify(frame(spark, []), one).count() == 0


def test_accuracy_on_held_out_rows(spark):
    """At least as good as telling nothing apart could be, on the table's own held-out labels."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = [r for r in queries.op10_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows])
    share = np.mean([labels[r["doc_id"]] for r in rows])
    assert right > max(share, 1 - share) + 0.02, (right, share)


def test_workers_keep_nothing_of_other_operators():
    def held():
        return bpe.load.cache_info().currsize, len(bpe._SEEN), pack._tokenizer.cache_info().currsize

    bpe.Encoder(WORD_FILE).learn([[b"one", b"two"]])
    pack.Tokens(BYTE_FILE)
    assert all(held())
    for keeps, want in (("bpe", (1, 1, 0)), (None, (0, 0, 0))):
        during = [held() for _ in lean(lambda rows: rows, keeps)(iter([None]))]
        assert tuple(map(bool, during[0])) == tuple(map(bool, want)) and held() == during[0]
