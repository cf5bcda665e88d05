"""Near-duplicates, repeated passages and the pipeline against plain versions."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import oracle
import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import SMALLEST
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import queries, similar, simhash, substring
from gridloom.llm.common import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, first=0):
    rows = [(first + k, t, "fp", 7, "h") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, n int, rest string")


def documents():
    return pq.read_table(f"{SMALLEST}/documents.parquet").to_pylist()


# --- SimHash -------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(ids, fps, most=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    distinct = sorted(root)
    a = np.array(distinct, np.uint64)
    for k, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= most):
            root[find(f)] = find(distinct[k + 1 + j])
    least = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            r = find(f)
            least[r] = min(i, least.get(r, i))
    return [least.get(find(f)) for f in fps]


def test_fingerprints_and_components(spark):
    texts = [None, "", " \t", "One two", "ONE TWO", "one", "ÀB çd Éf gh", *(d["text"] for d in documents()), "long word " * 30_000]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(range(len(texts)), fps)
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[k]["component_id"] for k in range(len(texts))] == want


def clustered(n, seed):
    """Fingerprints in dense clusters, chains of close ones, and alone."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = int(r.integers(0, 1 << 63)) * 2 + int(r.integers(0, 2))
        f = base
        for _ in range(int(r.integers(1, 12))):
            for b in r.choice(64, int(r.integers(0, 5)), replace=False):
                f ^= 1 << int(b)
            out.append(f)
    return sorted(set(out) | {0, (1 << 64) - 1, 7})


@pytest.mark.parametrize("group", [3, 40, 4096])
def test_links_lose_no_pair(spark, group):
    fps = clustered(120, group)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    folder = shared_folder(spark)
    edges = simhash.links(df, folder, 3, group)
    pairs = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in edges.collect()]
    assert all((a ^ b).bit_count() for a, b in pairs)
    roots = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(edges, folder).collect()} if pairs else {}
    want = defaultdict(set)
    for f, c in zip(fps, plain_components(range(len(fps)), fps), strict=True):
        want[c].add(f)
    got = defaultdict(set)
    for f in fps:
        got[roots.get(f, f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicate_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "something else entirely here"), (None, None)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5
    by_text = {(r["doc_id"], r["component_id"]) for r in out}
    assert by_text == {(None, 5), (5, 5), (9, 9), (None, None)}
    alone = simhash.near_duplicates(frame(spark, ["just one text"])).first()
    assert alone["component_id"] == 0


def plain_near_copies(texts):
    """Smallest number reachable over links of five-word Jaccard similarity 0.8 or more."""
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]))
    least = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and least[a] != least[b]:
                x, y = sorted((least[a], least[b]))
                least = [x if v == y else v for v in least]
    return least


@pytest.mark.parametrize("frequent, group", [(4, 20_000), (10**9, 7)])
def test_stage_reaches_similarity(spark, monkeypatch, frequent, group):
    """Copies at any number of differing bits are found, and nothing below 0.8 is."""
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        for changes in (0, 0, 1, 2, 3, 4, 5, 6):
            copy = base.copy()
            for at in rng.choice(150, changes, replace=False):
                copy[at] = f"z{rng.integers(10**6)}"
            texts.append(" ".join(copy + ["a", "line", "that", "all", "of", "them", "have"]))
    want = plain_near_copies(texts)
    fps = [plain_fingerprint(t) for t in texts]
    assert len(set(want)) < len(set(plain_components(list(range(len(texts))), fps)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar.near_copies(df, group=group).collect()} == dict(enumerate(want))
    kept = corpus_pipeline.deduplicated(spark, df, SMALLEST)
    assert {r["doc_id"] for r in kept.collect()} == set(want)


def test_near_copies_edges(spark):
    assert similar.near_copies(frame(spark, [])).count() == 0
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "A b c d"), (9, "something else entirely here"), (None, None)]
    out = similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and {(r["doc_id"], r["component_id"]) for r in out} == {(None, 5), (5, 5), (9, 9), (None, None)}


def test_gray_order():
    x = np.arange(256, dtype=np.uint64)
    by_rank = x[np.argsort(simhash.gray_rank(x))]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


# --- substring dedup -----------------------------------------------------------------------------------------------

def plain_removed(rows):
    """(id, words, which of them stay) of each row."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - 12):
                g = tuple(w[k : k + 13])
                first[g] = min(i, first.get(g, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    keep[k : k + 13] = [False] * 13
        out.append((i, w, keep))
    return out


def passages(seed=3):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "中文"]
    say = lambda n: " ".join(r.choice(vocabulary, n))
    shared = [say(n) for n in (12, 13, 14, 40, 90)]
    out = [None, "", " ", "a", say(13)]
    for _ in range(120):
        parts = [say(int(r.integers(0, 25)))]
        for _ in range(int(r.integers(0, 4))):
            parts += [shared[int(r.integers(0, 5))], say(int(r.integers(0, 20)))]
        out.append("\n".join(parts))
    out += [out[7], out[7] + " tail", "x " * 5000, "x " * 40, say(30_000)]
    return out


@pytest.mark.parametrize("frequent", [2, 60])
def test_removal(spark, monkeypatch, frequent):
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    rows = [*enumerate(passages())]
    rows += [(None, rows[9][1]), (20, rows[30][1])]
    df = spark.createDataFrame([(*r, "spans", 3) for r in rows], "doc_id long, text string, spans string, n_words int").repartition(5)
    want = sorted((str(i), len(w), len(w) - sum(k), hashlib.sha256(" ".join(x for x, y in zip(w, k, strict=True) if y).encode()).hexdigest()) for i, w, k in plain_removed(rows))
    got = substring.remove_repeats(df, digest=True).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    texts = substring.remove_repeats(df, keep=("spans", "n_words")).toDF("doc_id", "n", "gone", "kept_text", "spans", "own").collect()
    assert sorted(" ".join(WORD.findall(r["kept_text"])) for r in texts) == sorted(" ".join(x for x, y in zip(w, k, strict=True) if y) for _, w, k in plain_removed(rows))
    assert all(r["spans"] == "spans" and r["own"] == 3 for r in texts)


def test_factors_point_at_equal_words(spark):
    rows = [*enumerate(passages(5))]
    words = {i: WORD.findall(t or "") for i, t in rows}
    found = substring.factors(frame(spark, [t for _, t in rows])).collect()
    assert found
    for r in found:
        assert r["ref_doc"] < r["doc_id"] and r["n_words"] >= 13
        assert words[r["doc_id"]][r["start"] : r["start"] + r["n_words"]] == words[r["ref_doc"]][r["ref_start"] : r["ref_start"] + r["n_words"]]


def test_small_blocks_give_the_same(spark, monkeypatch):
    """A key of more words than a block is parsed in parts, and equal anchors alone remove nothing."""
    monkeypatch.setattr(substring, "FREQUENT", 10**9)
    r = np.random.default_rng(8)
    tail = lambda: " ".join(f"u{k}" for k in r.integers(0, 10**6, 9))
    texts = [f"the first four words {tail()}" for _ in range(600)] + ["the first four words " + "again " * 30] * 3
    texts += [f"{t} more" for t in texts[:50]]
    df = frame(spark, texts).repartition(7)
    spans = lambda rows: {(x["doc_id"], x["start"] + k) for x in rows for k in range(x["n_words"])}
    want = {(i, k) for i, _, keep in plain_removed([*enumerate(texts)]) for k, stays in enumerate(keep) if not stays}
    for words in (1, 100, 1 << 18):
        assert spans(substring.factors(df, block_words=words).collect()) == want


def plain_longest(words, doc):
    """Of each window of each segment the longest match (in windows) in a segment of an earlier document."""
    out = []
    for a, x in enumerate(words):
        for i in range(len(x) - 12):
            best = 0
            for b, y in enumerate(words):
                for j in range(len(y) - 12 if doc[b] < doc[a] else 0):
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                        n += 1
                    best = max(best, n - 12)
            out.append(best)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_parse_takes_the_longest_match(seed):
    r = np.random.default_rng(seed)
    size = r.integers(13, 40, r.integers(1, 8))
    words = r.integers(0, 2, size.sum()).astype(np.uint64)
    if seed % 3:
        words[:] = 0
        words[r.integers(0, len(words), 4)] = 5
    doc = r.integers(0, 4, len(size))
    block = substring.Block(words, size, doc, np.zeros(len(size), np.int64))
    length, _ = block.longest()
    assert length.tolist() == plain_longest(np.split(words, np.cumsum(size)[:-1]), doc)
    at, n, _, _ = block.factors()
    covered = np.zeros(len(length), bool)
    for x, m in zip(at, n, strict=True):
        assert m == length[x]
        covered[x : x + m] = True
    assert (covered == (length > 0)).all()


def test_unchanged_texts_stay_as_they_are(spark):
    texts = ["  lead and\ttabs \n end ", "short"]
    assert [r["kept_text"] for r in substring.remove_repeats(frame(spark, texts)).orderBy("doc_id").collect()] == texts
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_removal_against_sql(spark):
    con = oracle.connect(SMALLEST)
    assert oracle.compare(queries.op9_substring(spark, SMALLEST), con, queries.oracle_sql()["op9_substring"]) is None


# --- pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    """Each stage against a plain version over what its predecessor kept."""
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    folder, seen = shared_folder(spark), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALLEST)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{k}")
        seen[k] = (docs, spark.read.parquet(f"{folder}/{k}"))
        docs = seen[k][1]
    texts = {k: ({r["doc_id"]: r["text"] for r in a.collect()}, {r["doc_id"]: r["text"] for r in b.collect()}) for k, (a, b) in seen.items() if k < 4}
    for k in (0, 1):
        before, after = texts[k]
        assert set(after) <= set(before) and len(after) > 0.3 * len(before) and all(before[i] == t for i, t in after.items())
    before, after = texts[2]
    ids = sorted(before)
    assert set(after) == {ids[k] for k in plain_near_copies([before[i] for i in ids])}
    before, after = texts[3]
    want = {i: " ".join(x for x, y in zip(w, k, strict=True) if y) for i, w, k in plain_removed(sorted(before.items()))}
    assert {i: " ".join(WORD.findall(t)) for i, t in after.items()} == want
    assert set(seen[4][1].select("doc_id").distinct().toPandas()["doc_id"]) == set(after)
    assert corpus_pipeline.run(spark, SMALLEST).count() == seen[4][1].count()


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALLEST)
        assert docs.filter(F.lit(True)).count() == 0


def test_stages_take_any_rows_and_names(spark):
    """Columns named as operators name theirs, null texts and ids, and repeated rows."""
    names = ("score", "predicted", "held_out", "kept", "kept_text", "n_words", "n_removed", "at", "node", "rest", "own 0", "Text_hash")
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet").filter("doc_id < 80")
    docs = docs.unionByName(docs.filter("doc_id in (3, 4)")).unionByName(docs.filter("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.filter("doc_id = 9").withColumns({"doc_id": F.lit(900).cast("long"), "text": F.lit(None).cast("string")}))
    docs = docs.select(*[F.lit(f"own {x}").alias(x) for x in names], *docs.columns)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALLEST)
        if k == 4:
            assert out.filter("doc_id = 900").count() == 1
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[x] == f"own {x}" for r in rows for x in names), name
        ids = [r["doc_id"] for r in rows]
        if k == 2:
            assert len(set(ids)) == len(ids) and None not in ids and 900 in ids
        if k == 3:
            assert len(rows) == docs.count()
