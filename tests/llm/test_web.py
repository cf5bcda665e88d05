"""Url verdicts, archives, language and nearest neighbours against plain versions."""

import gzip
import hashlib
import math
from collections import Counter

import numpy as np
import oracle
import pyarrow.parquet as pq
import pytest
from conftest import SMALLEST
from pyspark.sql import functions as F

from gridloom.llm import ann, language, queries, urls, warc
from gridloom.llm.common import shared_folder

URLS = [None, "", "no scheme", "http://", "https://Example.ORG/es/x?q#f", "http://example.org/en/12", "http://sub.example.org/en/1", "http://notexample.org/es/", "http://a.com/fr/x", "http://a.com/de/", "http://a.com/DE/", "http://com/de/", "ftp://www.casino-win.example.net?x=/a", "http://notcasino-win.example.net/", "http://adult-x.example.com", "http://alphabets.com/", "http://x.net#frag", "http://é.Org/ü", "a://b://c/d", "http://org", "http://user@spam.test:80/p//q", "http://example.org/en/1"]


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_verdict(host, path):
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, "block" if any(host == x or host.endswith("." + x) for x in urls.LISTED) else "allow")


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "host", 1) for k, u in enumerate(URLS)] + [(3, URLS[4], "x", 2), (None, URLS[8], "y", 3)], "page_id long, url string, host string, path int")
    for bits in (urls.SHARD_BITS, 64):  # by one cascade, and by several
        rows = urls.judge(df, shard_bits=bits).collect()
        assert len(rows) == len(URLS) + 2
        for r in rows:
            if r["page_id"] is not None and (r["page_id"] != 3 or not r["host"]):
                host, path = plain_url(URLS[r["page_id"]])
                assert (r["host"], r["path"]) == (host, path) and (r["rule"], r["verdict"]) == plain_verdict(host, path), URLS[r["page_id"]]
    assert urls.judge(df.limit(0)).count() == 0
    by_table = urls.judge(df, rules=[], listed=spark.createDataFrame([("x.net", 1)], "domain string, host int")).filter("verdict = 'block'")
    assert [r["host"] for r in by_table.collect()] == ["x.net"]
    assert urls.judge(df, rules=[], listed=[]).filter("verdict = 'block'").count() == 0


@pytest.mark.parametrize("share", [0, 1, 10, 50, 100])
def test_cascade_is_exact(spark, share):
    keys = spark.range(2000).select(F.xxhash64("id", F.lit(1)).alias("a"), F.xxhash64("id", F.lit(2)).alias("b"), (F.col("id") % 100 < share).alias("listed"))
    c = urls.Cascade.build(keys)
    a, b, listed = (np.array(x) for x in zip(*keys.collect(), strict=True))
    assert (c.contains(a.view(np.uint64), b.view(np.uint64)) == listed).all()
    assert share in (0, 100) or len(c.levels) > 1


def test_urls_and_archives_against_sql(spark):
    con = oracle.connect(SMALLEST)
    for name in ("op5_urls", "op6_warc", "op8_ann"):
        assert oracle.compare(queries.queries()[name](spark, SMALLEST), con, queries.oracle_sql()[name]) is None, name


# --- archives ------------------------------------------------------------------------------------------------------

def test_captures(spark):
    big, odd = "x" * 1000, "WARC/1.1\r\n\r\n<html>\r\n\r\n\0é" * 60
    pages = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "http://c/", "small"), (5, "http://d/", "small"), (6, "u", None), (7, "u", ""), (8, "u", odd), (9, "u", odd), (10, "u", "é" * 500), (11, "u", "y" * 999), (12, "u", "y" * 999), (-13, "u", big * 3000)]
    df = spark.createDataFrame([(*p, "digest", 1) for p in pages], "page_id long, url string, html string, digest string, size int")
    got = {r["page_id"]: r for r in warc.captures(df).collect()}
    assert set(got) == {p[0] for p in pages}
    groups = {}
    for i, _, h in pages:
        groups.setdefault((h or "").encode(), []).append(i)
    for i, _, h in pages:
        body = (h or "").encode()
        later = len(body) >= 1000 and max(groups[body]) != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", max(groups[body])) if later else ("response", None))
    assert warc.captures(df.limit(0)).count() == 0


def test_every_row_is_captured(spark):
    """Null ids, repeated rows and repeated ids with other payloads; requests and metadata belong to their own row."""
    big, other = "x" * 1000, "y" * 1500
    pages = [(None, "http://n/", big), (None, "http://n/", big), (None, None, None), (5, "http://a/", big), (5, "http://a/", big), (5, "http://b/", other), (5, "http://c/", "small"), (9, "http://d/", big), (9, "http://d/", big), (2, "http://e/", other)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = warc.captures(df).collect()
    plain = Counter()
    for i, u, h in pages:
        size, chief = len(h or ""), max(j for j, _, g in pages if g == h and j is not None) if h and any(j is not None and g == h for j, _, g in pages) else None
        later = size >= 1000 and i is not None and i < chief
        plain[i, u, size, hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if later else "response", chief if later else None] += 1
    assert Counter((r["page_id"], r["request"]["target_uri"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == plain
    assert all(r["capture"]["target_uri"] == r["request"]["target_uri"] == r["metadata"][0]["target_uri"] and len(r["metadata"]) == 1 for r in rows)
    assert len({r["capture_id"] for r in rows}) == len(pages)


def test_archives_are_read_in_parts():
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    bodies = [b"WARC/1.1 \r\n\r\n" * 40, b"", b"z" * 5000]
    data = b"".join(one % (k, len(x), x) for k, x in enumerate(bodies))
    for packed in (data, gzip.compress(data), gzip.compress(data[:700]) + gzip.compress(data[700:])):
        for step in (1, 7, 100, 1 << 20):
            assert [(h["warc-record-id"], x) for h, x in warc.parse(packed, step)] == [(f"<urn:{k}>", x) for k, x in enumerate(bodies)]


def test_transactions_are_nested(spark):
    df = spark.createDataFrame([(k, f"http://h/{k}", f"page {k}") for k in range(5)], "page_id long, url string, html string")
    path = f"{shared_folder(spark)}/w"
    warc.write(df, path)
    rows = warc.transactions(warc.read(spark, path)).collect()
    assert len(rows) == 5
    for r in rows:
        k = int(r["capture_id"].split(":")[2])
        assert r["request"]["concurrent_to"] == r["capture_id"] == r["capture"]["record_id"]
        assert r["request"]["type"] == "request" and r["capture"]["type"] == "response" and len(r["metadata"]) == 1
        assert bytes(r["capture"]["payload"]) == f"page {k}".encode() and r["capture"]["target_uri"] == f"http://h/{k}"
        assert r["metadata"][0]["fields"] == {"payloadLength": str(len(f"page {k}"))}


def test_foreign_archives(spark, tmp_path):
    """Members of their own, base-32 digests, a damaged tail."""
    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nWARC-Target-URI: u\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    two = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:b>\r\nWARC-Refers-To: <urn:a>\r\nWARC-Payload-Digest: sha1:YKTZDU5HY5GHWTGUB25S7JM6FWMZQHXS\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + b"\x1f\x8bbroken")
    rows = {r["record_id"]: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert bytes(rows["urn:a"]["payload"]) == b"hi" and rows["urn:a"]["digest"] == hashlib.sha1(b"hi").hexdigest()
    assert rows["urn:b"]["refers_to"] == "urn:a" and len(rows["urn:b"]["digest"]) == 40
    t = {r["capture_id"]: r for r in warc.transactions(warc.read(spark, str(tmp_path))).collect()}
    assert t["urn:a"]["request"] is None and t["urn:a"]["metadata"] == []


# --- language ------------------------------------------------------------------------------------------------------

def test_language(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = queries.op7_language(spark, sf).collect()
    found = {r["doc_id"]: r["lang"] for r in rows if r["doc_id"] is not None}
    assert set(found) == set(truth) and np.mean([found[i] == l for i, l in truth.items() if l]) > 0.9
    assert sum(r["page_id"] is not None for r in rows) == pq.read_table(f"{sf}/pages.parquet").num_rows
    assert all(0 < r["confidence"] <= 1 + 1e-9 for r in rows)


def test_language_of_little(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog" if k % 2 else "der hund und die katze", "en" if k % 2 else "de", "src" if k < 8 else None, "h") for k in range(40)] + [(100, None, "en", "src", "h"), (101, "", None, None, "h"), (None, "the dog", None, None, "h"), (3, "the cat and the dog", "en", "src", "h")], "doc_id long, text string, lang string, source string, host string")
    pages = spark.createDataFrame([(1, "http://a.de/x", "<html lang=de><body>und</body></html>"), (2, "http://b.de/", "<p>die katze und der hund</p><script>the the the</script>"), (3, None, None)], "page_id long, url string, html string")
    rows = language.identify(docs, pages).collect()
    assert len(rows) == 47 and all(r["lang"] in ("de", "en") for r in rows)
    by_page = {r["page_id"]: r for r in rows if r["page_id"]}
    assert by_page[1]["lang"] == by_page[2]["lang"] == "de" and by_page[3]["text_lang"] is None
    assert {r["lang"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}
    assert language.identify(docs.limit(0), pages.limit(0)).count() == 0


def test_priors_decide_where_texts_do_not(spark):
    """A host's other rows speak for its empty ones."""
    docs = spark.createDataFrame([(k, "the cat and the dog sat down here", "en", "english.site") for k in range(30)] + [(50 + k, "der hund und die katze sind jetzt da", "de", "deutsch.site") for k in range(30)] + [(98, "", None, "english.site"), (99, "", None, "deutsch.site")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["lang"] for r in language.identify(docs).collect()}
    assert (got[98], got[99]) == ("en", "de")


def test_every_label_is_fitted(spark):
    """However many labels there are, and however rare one is."""
    rows = [(k, f"lang{k % 70:02d} " * 5, f"l{k % 70:02d}") for k in range(700)] + [(1000, "qqq xyx qqq", "rare")]
    names, table = language.fit(spark.createDataFrame(rows, "id long, text string, lang string"), "text", "lang", "id", sample=5)
    assert names == sorted({r[2] for r in rows})
    bucket, _ = language._usable(np.frombuffer(b"qqq xyx qqq", np.uint8), np.array([0, 11]))
    assert table[:, bucket].sum(axis=1).argmax() == names.index("rare")


def test_markup_is_found_anywhere(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "<!-- " + "licence " * 1000 + "-->\n<html class=x lang='de'><p>x</p></html>")], "page_id long, url string, html string")
    assert language.evidence(pages, "page_id", "html", url_col="url", html=True).first()["markup"] == "de"


def test_visible_text():
    assert language.visible(b"<p>a&amp;b</p><!-- no --><script>x</script><STYLE>y</STYLE>c").split() == [b"a", b"b", b"c"]


# --- nearest neighbours --------------------------------------------------------------------------------------------

def plain_nearest(rows, queries_, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = []
    for i, q in [g for g in good if g[0] in queries_]:
        near = sorted((math.sqrt(sum((a - b) * (a - b) for a, b in zip(q, v, strict=True))), j) for j, v in good if j != i)
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return out


def test_nearest(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.standard_normal(16)]) for k in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(40)]  # copies: ties
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (None, [1.0] * 16), (905, [1.0] * 15), (906, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(4)
    asked = df.filter("vec_id % 10 = 0 or vec_id > 899")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in ann.nearest(df, asked).collect())
    want = sorted(plain_nearest([x for x in rows if x[1] is None or len(x[1]) != 15], {x[0] for x in rows if x[0] is not None and (x[0] % 10 == 0 or x[0] > 899)}))
    assert got == want


def test_nearest_in_blocks_and_of_few(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 4)
    rows = [(k, [float(k), 1.0]) for k in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(df, df, block_bytes=64).collect())
    assert got == sorted(plain_nearest(rows, set(range(9)))) and len(got) == 9 * 8
    assert ann.nearest(df, df.limit(0)).count() == 0 and ann.nearest(df.limit(0), df).count() == 0
    one = df.limit(1)
    assert ann.nearest(one, one).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    x, q = r.standard_normal((2000, 64)), r.standard_normal((50, 64))
    turn, centre = ann.rotation(64), x.mean(axis=0)
    low, high = ann.Codes.of(x, centre, turn).bounds((q - centre) @ turn)
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.mean((low <= true) & (true <= high)) > 0.99 and np.mean(high - low < np.abs(true).max()) > 0.5
    assert np.allclose(turn @ turn.T, np.eye(64))


def test_recall_and_pruning(spark):
    df = spark.read.parquet(f"{SMALLEST}/embeddings.parquet")
    rows = [(x["vec_id"], x["embedding"]) for x in df.collect()]
    got = Counter((x["query_id"], x["vec_id"]) for x in queries.op8_ann(spark, SMALLEST).collect())
    want = Counter((i, j) for i, _, j, _ in plain_nearest(rows, {i for i, _ in rows if i is not None and i % 100 == 0}))
    assert sum((got & want).values()) >= 0.99 * sum(want.values())
    x = np.array([v for _, v in rows if v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all() and np.any(v)], float)
    ids = np.arange(len(x))
    counts: list[int] = []
    import pyarrow as pa

    c = ann.Codes.of(x, x.mean(axis=0), ann.rotation(64))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float64())), pa.array([b.tobytes() for b in c.bits]), pa.array(c.norm), pa.array(c.scale)], names=["vec_id", "v", "bits", "norm", "scale"])
    list(ann._scan(ids[::100], x[::100], x.mean(axis=0), 10, counts)(iter([batch])))
    assert sum(counts) < len(x) * len(x[::100])  # some are never computed exactly
