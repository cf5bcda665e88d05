"""Scores and layouts recomputed step by step in plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_text import WORD
from tokenizers import Tokenizer

from gridloom.llm import language, pack, quality, rules
from gridloom.llm.common import mix

# --- quality rules -------------------------------------------------------------------------------------------------

def _long(x, seed=42):
    return xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), seed)


def plain_grams(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    return [x % rules.BUCKETS for x in h + [_long(b, _long(a)) for a, b in zip(h, h[1:], strict=False)]]


def test_score_is_the_likelihood_ratio(spark):
    r = np.random.default_rng(2)
    say = lambda low, n: " ".join(f"w{x}" for x in r.integers(low, low + 40, n))
    texts = [say(0, 60) for _ in range(40)] + [say(30, 70) for _ in range(40)] + [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = df.filter("doc_id < 25").select("doc_id")
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(plain_grams(t))
        target.update(plain_grams(t) if i < 25 else [])
    share = sum(target.values()) / sum(raw.values())
    step = {b: max(-127, min(127, round(rules.STEPS * math.log((target[b] + rules.PRIOR) / (n * share + rules.PRIOR))))) for b, n in raw.items()}
    for x in rules.judge(df, trusted).collect():
        grams = plain_grams(texts[x["doc_id"]])
        want = sum(step[b] for b in grams) / rules.STEPS / max(len(grams), 1)
        assert abs(x["score"] - want) < 1e-9 and x["kept"] == (not x["base_failed"] and want >= rules.THRESHOLD)


# --- packing -------------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_fit_is_the_naive_one(lengths):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        open_ = [k for k, room in enumerate(rooms) if room >= n]
        if open_:
            rooms[min(open_, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(30 - n)
    windows, room = pack.fitted(np.array(lengths, np.int64), 30)
    assert sorted(room) == sorted(rooms) and len(windows) == len(rooms)


def test_long_runs_are_packed(spark):
    """White space or letters without end: what the quick library can't take goes to the other."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, tokens = Tokenizer.from_file(path), pack.Tokens(path)
    for text in (" " * 1_000_000 + "x", "a" + "\n\t " * 400_000, "a " + " " * 20_000 + "\n" * 20_000 + "b", "ab" * 30_000, " " * 16_383 + "x"):
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, " " * 1_000_000), (None, None)], "doc_id long, text string")
    assert pack.pack(df, path).agg(F.sum("length")).first()[0] == len(library.encode(" " * 1_000_000, add_special_tokens=False).ids) + 2


# --- language ------------------------------------------------------------------------------------------------------

def _normal(x):
    e = np.exp(x - np.max(x))
    return e / e.sum()


def test_posterior_is_the_product_of_all_evidence(spark):
    r = np.random.default_rng(4)
    say = {"en": "the cat and the dog sat on a mat with that hat", "de": "der hund und die katze sind auf dem dach", "fr": "le chat et le chien sont sur la table"}
    docs = [(k, " ".join(r.choice(say[lang].split(), 6)), lang, f"s{k % 4}") for k, lang in enumerate(["en", "de", "fr"] * 12)] + [(90, "", None, "s1"), (91, None, None, None), (92, "xyz", None, "s2")]
    pages = [(k, f"http://{h}/p", f"<html{m}><p>{' '.join(r.choice(say[lang].split(), 3))}</p>") for k, (h, m, lang) in enumerate([("a.x.de", " lang=de", "de"), ("b.x.de", "", "en"), ("c.fr", " lang='fr'", "fr"), ("c.fr", " lang=de", "fr"), ("d.org", "", "en")])] + [(7, None, None)]
    df, pf = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(pages, "page_id long, url string, html string")
    names, table = language.fit(df, "text", "lang", "doc_id")
    table = table - table.mean(axis=0)
    rows = []
    for i, text, _, host in docs:
        rows.append(("doc", i, (text or "").encode(), host, host, None, None))
    for i, url, html in pages:
        host = url.split("/")[2] if url else None
        lang = next((html.split("lang=")[1].strip("'")[:2] for _ in [0] if html and "lang=" in html), None)
        rows.append(("page", i, language.visible((html or "").encode()), host, ".".join(host.split(".")[-2:]) if host else None, host.split(".")[-1] if host else None, lang))
    n, found = len(names), {}
    text_ll = []
    for x in rows:
        low = bytes(language._LETTER[np.frombuffer(x[2], np.uint8)])
        grams = [low[k : k + 3] for k in range(len(low) - 2) if low[k : k + 3].strip()]
        place = [((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32) >> 16 for g in grams]
        text_ll.append(sum((table[:, p].astype(float) for p in place), np.zeros(n)) * language.WEIGHT)
    alone = [_normal(x) for x in text_ll]
    world = sum(alone) + 1
    world = world / world.sum()
    by = lambda k: {v: sum(a for a, x in zip(alone, rows, strict=True) if x[k] == v) for v in {x[k] for x in rows} - {None}}
    hosts, domains, suffixes, markups = by(3), by(4), by(5), by(6)
    for x, ll in zip(rows, text_ll, strict=True):
        score = ll.copy()
        if x[3] is None:
            score = score + np.log(world)
        else:
            p = domains[x[4]] + language.DOMAIN_STRENGTH * world
            q = hosts[x[3]] + language.HOST_STRENGTH * p / p.sum()
            score = score + np.log(q / q.sum())
        for k, counts in ((5, suffixes), (6, markups)):
            if x[k] is not None:
                score = score + np.log((counts[x[k]] + language.EVEN / len(counts)) / (sum(counts.values()) + language.EVEN))
        found[x[0], x[1]] = _normal(score)
    for x in language.identify(df, pf).collect():
        want = found["doc" if x["doc_id"] is not None else "page", x["doc_id"] if x["doc_id"] is not None else x["page_id"]]
        assert abs(x["confidence"] - want.max()) < 1e-4
        assert x["lang"] == names[int(want.argmax())] or np.sort(want)[-1] - np.sort(want)[-2] < 1e-4


# --- quality classifier --------------------------------------------------------------------------------------------

def plain_hash(word):
    """A polynomial over the bytes, then the finaliser."""
    base, total = 0x9E3779B97F4A7C15, 0
    for k, c in enumerate(word.encode()):
        total += (c + 1) * pow(base, k + 1, 2**64)
    return int(mix(np.array([(total + len(word.encode())) % 2**64], np.uint64))[0])


def plain_index(h):
    v = np.zeros(quality.DIM)
    for k in range(quality.SEEDS):
        v[h >> 8 * k & quality.DIM - 1] += 1 if h >> 8 * k + 6 & 1 else -1
    return v


def test_features_are_pooled_word_vectors(spark):
    texts = ["a b a c", "b b b", "", None, "c a b d e f a"]
    words = [[plain_hash(w) for w in WORD.findall(t or "")] for t in texts]
    place = lambda h: (h >> 40) % quality.BUCKETS
    sums, count = defaultdict(lambda: np.zeros(quality.DIM)), Counter()
    for ws in words:
        for i, h in enumerate(ws):
            count[place(h)] += 1
            for off in (-2, -1, 1, 2):
                if 0 <= i + off < len(ws):
                    sums[place(h)] += plain_index(ws[i + off])
    got = quality.neighbour_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    assert {b: n for b, n in enumerate(got[:, -1]) if n} == count and all((got[b, :-1] == sums[b]).all() for b in count)
    total, n = sum(sums.values()), sum(count.values())
    vectors = quality.word_vectors(got)
    vector = {}
    for b in count:
        v = (sums[b] - count[b] * total / n) / math.sqrt(count[b] + 10)
        vector[b] = np.sign(v) * np.log1p(np.abs(v))
        assert np.allclose(vectors[b], vector[b], atol=1e-5)
    from gridloom.llm.common import flat_bytes
    import pyarrow as pa

    pooled = quality.pooled(vectors, *flat_bytes(pa.array(texts)), step=2)
    for ws, x in zip(words, pooled, strict=True):
        if not ws:
            assert not x.any()
            continue
        v, own = np.array([vector[place(h)] for h in ws]), np.mean([plain_index(h) for h in ws], axis=0)
        agree = sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / len(ws)
        assert np.allclose(x, [*v.mean(axis=0), *np.sqrt((v * v).mean(axis=0)), *own, np.linalg.norm(own), agree], atol=1e-4)


def test_network_and_temperature():
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 5)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] ** 2 + r.standard_normal(400) > 0.5).astype(np.int64)
    held = np.arange(400) % 5 == 0
    net = quality.Network(x, y, held)
    w1, b1, w2, b2 = net.weights
    for row in x[:30]:
        z = [max(-8, min(8, (float(v) - m) / s)) for v, m, s in zip(row, net.mean, net.spread, strict=True)]
        hidden = [max(0.0, sum(a * w1[i][j] for i, a in enumerate(z)) + b1[j]) for j in range(len(b1))]
        logit = sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]
        assert abs(net.scores(row[None])[0] - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-6
    loss = lambda c: np.mean([math.log1p(math.exp(-(1 if t else -1) * v / c)) for v, t in zip(net.logits(x[held]), y[held], strict=True)])
    assert loss(net.temperature) <= min(loss(c) for c in np.exp(np.linspace(-1.5, 3, 91))) + 1e-9
    assert np.mean((net.scores(x) >= 0.5) == y) > 0.75


@pytest.mark.parametrize("first", [0, 1])
def test_repeated_ids_have_one_model(spark, first):
    """Which of an id's texts is learnt from does not depend on the order of rows."""
    rows = [(k % 30, f"good words here {k % 7} {k}" if k % 2 else f"bad junk {k}") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, *([F.col("text")] if first else []))
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    got = sorted((r["doc_id"], round(r["score"], 9)) for r in quality.classify(df, labels).collect())
    again = sorted((r["doc_id"], round(r["score"], 9)) for r in quality.classify(spark.createDataFrame(rows[::-1], "doc_id long, text string"), labels).collect())
    assert got == again
