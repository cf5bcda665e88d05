"""Language identification by Bayesian evidence fusion.

Hashed byte trigrams, fitted on a bounded sample of each language's labelled texts, give each text a likelihood per language. Over all
rows the languages that texts alone suggest are added up by host, domain, address suffix and declared markup
language. A host's prior is smoothed towards its domain's, and that towards the corpus's; suffix and markup give
likelihoods of their own. The posterior is the product of all four kinds of evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches, flat_bytes, lean, shared_folder, texts, written
from gridloom.llm.urls import host_and_path

BUCKETS = 1 << 16
#: Labelled texts of each language that the likelihoods are fitted on, about; all texts of a language with fewer.
SAMPLE = 10_000
#: Trigrams overlap, so each counts as this part of an independent one.
WEIGHT = 0.2
#: Rows that a domain counts for in its hosts' priors, and the corpus in its domains'.
HOST_STRENGTH, DOMAIN_STRENGTH = 10.0, 20.0
#: Rows spread evenly over suffix and markup tables.
EVEN = 2.0

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)

_SKIPPED = re.compile(rb"<!--.*?-->|<(script|style|nav|header|footer|aside|noscript)\b.*?</\1\s*>|<div class=\"ad\".*?</div>", re.S | re.I)
_TAG = re.compile(rb"<[^<>]*>")
_ENTITY = re.compile(rb"&[#\w]{1,32};")


def visible(html: bytes) -> bytes:
    """Text outside scripts, styles, comments, page furniture and tags."""
    return _ENTITY.sub(b" ", _TAG.sub(b" ", _SKIPPED.sub(b" ", html)))


def _trigrams(data: np.ndarray) -> np.ndarray:
    x = _LETTER[data].astype(np.uint32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def _usable(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the trigrams within texts that are not white space alone."""
    if len(data) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    letters = _LETTER[data] != 32
    good = (text[:-2] == text[2:]) & (letters[:-2] | letters[1:-1] | letters[2:])
    return _trigrams(data)[good], text[:-2][good]


def fit(df: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages in order of name, log likelihood of each language's trigram buckets)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null and id is not null")
    sizes = rows.groupBy("lang").count()
    names = sorted(r["lang"] for r in sizes.select("lang").collect())  # as many as there are labels
    number = {x: k for k, x in enumerate(names)}
    part = sizes.select("lang", (F.lit(float(sample)) / F.col("count")).alias("part"))
    chosen = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32)) < F.col("part") * float(1 << 32)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 2), np.int64)  # place in the table of all languages, and count
        for batch in batches(it, 0):
            bucket, text = _usable(*flat_bytes(batch.column(0)))
            lang = np.array([number[x] for x in batch.column(1).to_pylist()])[text]
            now = np.stack(np.unique(lang * BUCKETS + bucket.astype(np.int64), return_counts=True), axis=1)
            both = np.concatenate([total, now])
            place, at = np.unique(both[:, 0], return_inverse=True)
            total = np.stack([place, np.bincount(at, both[:, 1], len(place)).astype(np.int64)], axis=1)
        lang, bucket = np.divmod(total[:, 0], BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(np.ascontiguousarray(total[:, 1]))], names=["lang", "bucket", "n"])

    counts = rows.join(F.broadcast(part), "lang").filter(chosen).select("text", "lang").mapInArrow(lean(run), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((len(names), BUCKETS))
    total[counts["lang"], counts["bucket"]] = counts["n"]
    share = total.sum(axis=0) / max(total.sum(), 1) + 1e-9
    smooth = total + 200 * share
    return names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def likelihoods(rows: DataFrame, table: np.ndarray, step: int = 1 << 20) -> DataFrame:
    """``text_ll`` (array of double) in the place of ``text``; ``is_html`` says whose visible text counts."""
    table = table - table.mean(axis=0)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 0):
            parts = [visible(x) if h else x for x, h in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
            offsets = np.cumsum([0, *map(len, parts)])
            bucket, text = _usable(np.frombuffer(b"".join(parts), np.uint8), offsets)
            out = np.zeros((len(parts), len(table)))
            for lo in range(0, len(bucket), step):
                t, b = text[lo : lo + step], bucket[lo : lo + step]
                first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                for k in range(len(table)):
                    out[t[first], k] += np.add.reduceat(table[k][b], first, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(list(out * WEIGHT), pa.list_(pa.float64()))], names=[*batch.schema.names[2:], "text_ll"])

    kept = [x for x in rows.columns if x not in ("text", "is_html")]
    schema = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in kept)
    return rows.select("text", "is_html", *kept).mapInArrow(lean(run), f"{schema}, text_ll array<double>")


def evidence(df: DataFrame, id_col: str, text_col: str, url_col: str | None = None, host_col: str | None = None, html: bool = False) -> DataFrame:
    """``id, text, is_html, host, domain, suffix, markup`` of a table; what it lacks is null."""
    none = F.lit(None).cast("string")
    host = host_and_path(F.col(url_col).cast("string"))[0] if url_col else F.col(host_col).cast("string") if host_col else none
    host = F.when(F.length(host) > 0, host)
    labels = F.split(host, r"\.")
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1)) if url_col else none
    domain = F.array_join(F.slice(labels, -2, 2), ".") if url_col else host
    domain = F.when(F.size(labels) > 1, domain).otherwise(host)
    text = F.col(text_col).cast("string")
    markup = F.lower(F.substring(F.nullif(F.regexp_extract(text, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")), 1, 3)) if html else none
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.lit(html).alias("is_html"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), markup.alias("markup"))


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def fuse(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``lang, confidence, text_lang`` to ``host, domain, suffix, markup, text_ll`` and other columns."""
    span = range(len(names))
    rows = rows.withColumn("alone", _softmax(F.col("text_ll")))
    sums = [F.round(F.sum(F.get("alone", F.lit(k))), 6).alias(f"n{k}") for k in span]
    every = lambda: [F.sum(f"n{k}").alias(f"n{k}") for k in span]
    as_array = lambda prefix="n": F.array(*[F.col(f"{prefix}{k}").cast("double") for k in span])
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    base = rows.groupBy().agg(*sums).first()
    whole = [float(base[f"n{k}"] or 0) + 1.0 for k in span]
    world = F.array(*[F.lit(x / sum(whole)) for x in whole])
    hosts = rows.filter("host is not null").groupBy("host", "domain").agg(*sums)
    domains = hosts.groupBy("domain").agg(*every()).select("domain", as_array().alias("n"))
    domains = domains.select("domain", F.zip_with("n", world, lambda n, w: n + DOMAIN_STRENGTH * w).alias("p")).select("domain", F.transform("p", lambda x: x / add(F.col("p"))).alias("p"))
    hosts = hosts.join(domains, "domain").select("host", "domain", F.zip_with(as_array(), "p", lambda n, p: n + HOST_STRENGTH * p).alias("q")).select("host", "domain", F.transform("q", lambda x: F.log(x / add(F.col("q")))).alias("prior"))

    hosts = written(hosts, shared_folder(rows.sparkSession), "hosts")  # a plain side of the join below, so Spark can split a host with many rows

    def likely(column: str) -> DataFrame:
        """log P(value | language), with a few rows of each language spread evenly over the values."""
        counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(*sums)
        size = counts.agg(F.count("*").alias("values"), *[F.sum(f"n{k}").alias(f"t{k}") for k in span]).first()
        values = max(size["values"], 1)
        return counts.select(column, F.array(*[F.log((F.col(f"n{k}") + EVEN / values) / F.lit(float(size[f"t{k}"] or 0) + EVEN)) for k in span]).alias(f"{column}_ll"))

    out = rows.join(hosts, ["host", "domain"], "left").join(likely("suffix"), "suffix", "left").join(likely("markup"), "markup", "left")
    flat = F.array(*[F.lit(0.0) for _ in span])
    terms = [F.col("text_ll"), F.coalesce("prior", F.transform(world, lambda x: F.log(x))), F.coalesce("suffix_ll", flat), F.coalesce("markup_ll", flat)]
    out = out.withColumn("fused", reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), terms)).withColumn("posterior", _softmax(F.col("fused")))
    name = lambda x: F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(x, F.array_max(x)) - 1).cast("int"))
    return out.withColumn("lang", name(F.col("posterior"))).withColumn("confidence", F.array_max("posterior")).withColumn("text_lang", F.when(F.size(F.array_distinct("text_ll")) > 1, name(F.col("text_ll"))))


def identify(labelled: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str | None = "source") -> DataFrame:
    """Languages of all rows of ``labelled`` (texts, with a host but no address) and ``pages`` (``page_id, url, html``).

    Returns ``doc_id, page_id`` (one of them null), ``lang, confidence, text_lang`` (what the text alone says, null without text).
    ``lang_col`` trains the likelihoods on a bounded sample and is no evidence for its row. Ties go to the first name. Null and empty
    texts are decided by the other evidence, and null hosts, suffixes and markup give none; rows with null
    or repeated ids are judged each. Without any labelled text lang is null. Empty tables give an empty result.
    """
    spark = labelled.sparkSession
    names, table = fit(labelled, text_col, lang_col, id_col)
    none = F.lit(None).cast("long")
    rows = evidence(labelled, id_col, text_col, host_col=host_col).select(F.col("id").alias("doc_id"), none.alias("page_id"), "text", "is_html", "host", "domain", "suffix", "markup")
    if pages is not None:
        rows = rows.unionByName(evidence(pages, "page_id", "html", url_col="url", html=True).select(none.alias("doc_id"), F.col("id").alias("page_id"), "text", "is_html", "host", "domain", "suffix", "markup"))
    if not names:
        return rows.select("doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    scored = written(likelihoods(rows, table), shared_folder(spark), "likelihoods")
    return fuse(scored, names).select("doc_id", "page_id", "lang", "confidence", "text_lang")
