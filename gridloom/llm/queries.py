"""The registered queries of this subpackage, ``opN_<name>``, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import ann, bpe, language, pack, quality, rules, simhash, substring, urls, warc
from gridloom.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), outputs=("ids_sha256", "decoded_sha256"))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


OP5_SQL = f"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM p),
s AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, len(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
rules(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, max_by(rhost || rpath, len(rhost || rpath)) AS rule, max_by(v, len(rhost || rpath)) AS v
  FROM s JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
listed(domain) AS (VALUES {", ".join(f"('{x}')" for x in urls.LISTED)}),
bad AS (SELECT DISTINCT host FROM s JOIN listed ON host = domain OR ends_with(host, '.' || domain))
SELECT s.page_id, s.host, path, rule, coalesce(v, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM s LEFT JOIN best USING (page_id) LEFT JOIN bad ON s.host = bad.host
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
c AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS chief FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND chief > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND chief > page_id THEN chief END AS refers_to
FROM c
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


OP8_SQL = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id, 
    sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, x: a + x)) AS score
  FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM near) WHERE rank <= 10
"""


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT g, min(doc_id) AS d FROM grams GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT grams.doc_id, unnest(range(i, i + 13)) AS p FROM grams JOIN firsts USING (g) WHERE grams.doc_id > firsts.d)),
marked AS (
  SELECT w.doc_id, p.pos, p.word, gone.p IS NULL AS kept
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w) p
  JOIN w USING (doc_id) LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.pos)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(count(m.pos) FILTER (NOT m.kept) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.pos) FILTER (m.kept), '')) AS kept_sha256
FROM w LEFT JOIN marked m ON m.doc_id = w.doc_id GROUP BY w.doc_id, len(w.ws)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_rules": op2_rules, "op3_pack": op3_pack, "op4_simhash": op4_simhash, "op5_urls": op5_urls, "op6_warc": op6_warc, "op7_language": op7_language, "op8_ann": op8_ann, "op9_substring": op9_substring, "op10_quality": op10_quality}


def oracle_sql() -> dict[str, str]:
    return {"op5_urls": OP5_SQL, "op6_warc": OP6_SQL, "op8_ann": OP8_SQL, "op9_substring": OP9_SQL}
