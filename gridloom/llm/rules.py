"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Only DataFrame functions run here. Words and pairs of neighbouring words are hashed to a fixed number of buckets; two
multinomials over the buckets, of the trusted texts and of all texts, give each bucket a log ratio; a text's score is
the mean ratio of its n-grams, so length does not count, and the verdict is a fixed threshold on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import words

BUCKETS = 1 << 17
#: Ratios are held in steps of 1 / STEPS, from -127 to 127 of them: no single n-gram decides, and a task's table stays small.
STEPS = 32
#: n-grams added to each bucket on both sides: a bucket that was seldom seen says little.
PRIOR = 4.0
#: Mean log ratio below which a text is rejected.
THRESHOLD = -0.16
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bits that trusted ids are hashed to (8 MB at most): a row whose bit is unset is not trusted, others are looked up.
BITS = 1 << 26
SYMBOLS = "#*$%&|<>"
_SPACES = r" \t\n\x0b\x0c\r"


def _at(i: Column | str, h: str = "h") -> Column:
    return F.get(F.col(h), i)


def _pairs() -> Column:
    """Hashes of neighbouring words (column ``h``, ``n_words``)."""
    most = F.greatest(F.col("n_words") - 1, F.lit(0)).cast("int")
    return F.zip_with(F.slice("h", 1, most), F.slice("h", F.lit(2), most), lambda a, b: F.xxhash64(a, b))


def _bucket(x: Column) -> Column:
    return x.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")  # BUCKETS is a power of two


def _hashed(df: DataFrame, id_col: str, text_col: str, more: tuple[Column, ...] = ()) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)
    rows = rows.withColumn("w", words(F.col("text")))
    return rows.withColumn("n_words", F.size("w").cast("long")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def marked(rows: DataFrame, ids: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` (``doc_id, text``) with ``trusted``: 1 where ``ids`` (distinct) has the id, else null.

    Only rows whose id's bit is set are joined and their texts moved, by a plain join, so Spark can split an id with many
    rows; all others are done where they are. The plan is the same whatever the number of ids. With many more ids than
    bits more rows are moved, and the marks stay exact.
    """
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    number, at = F.bitmap_bucket_number(place).alias("number"), F.bitmap_bit_position(place).alias("at")
    maps = ids.select(number, at).repartition("number").groupBy("number").agg(F.bitmap_construct_agg("at").alias("map"))
    rows = rows.select("doc_id", "text", number, at).join(F.broadcast(maps), "number", "left")
    byte = F.conv(F.hex(F.substring("map", (F.col("at") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    likely = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.col("at") % 8).cast("int") + 1)) != 0, F.lit(False))
    found = rows.filter(likely).select("doc_id", "text").join(ids.withColumn("trusted", F.lit(1)).hint("merge"), "doc_id", "left")
    return found.unionByName(rows.filter(~likely).select("doc_id", "text", F.lit(None).cast("int").alias("trusted")))


def bucket_ratios(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Log ratios of all buckets in whole steps, comma-separated: a value of fixed size, whatever the corpus.

    ``trusted`` has the ids (``doc_id``) of trusted rows; all of them count. n-grams of all rows are counted in one pass:
    tasks add up before a shuffle of a row per bucket and task.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    rows = marked(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ids)
    rows = _hashed(rows, "doc_id", "text", (F.col("trusted"),))
    grams = rows.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(F.concat(F.col("h"), _pairs())).alias("g"))
    counts = grams.groupBy(_bucket(F.col("g")).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")).toPandas()
    raw, target = counts["raw"].astype(float), counts["target"].astype(float)
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    steps = np.zeros(BUCKETS, np.int64)
    steps[counts["bucket"]] = np.clip(np.rint(STEPS * np.log((target + PRIOR) / (expected + PRIOR))), -127, 127)
    return ",".join(map(str, steps.tolist()))


def base_columns(rows: DataFrame) -> DataFrame:
    """Adds ``word_chars, n_symbols, n_dup_lines, n_repeat_words`` to ``doc_id, text, w, n_words, h``."""
    most = F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")
    rows = rows.withColumn("x", F.transform(F.slice("h", 1, most), lambda a, i: F.xxhash64(a, _at(i + 1), _at(i + 2))))
    twice = F.size(F.array_distinct("x")) < F.size("x")
    # only where a window is repeated: windows with their places in order of windows, then the places of repeated ones
    rows = rows.withColumn("t", F.when(twice, F.sort_array(F.transform("x", lambda a, i: F.struct(a.alias("a"), i.alias("i"))))))
    same = F.filter("t", lambda e, i: (e["a"] == F.get(F.col("t"), i + 1)["a"]) | (e["a"] == F.when(i > 0, F.get(F.col("t"), F.greatest(i - 1, F.lit(0)))["a"])))
    rows = rows.withColumn("p", F.sort_array(F.transform(same, lambda e: e["i"])))
    covered = F.transform("p", lambda v, i: F.least(F.lit(3), F.coalesce(F.get(F.col("p"), i + 1), v + 3) - v))
    # lines with a word are looked for only where some line is repeated
    rows = rows.withColumn("lines", F.split("text", "\n")).withColumn("unlike", F.array_distinct("lines"))
    worded = lambda c: F.size(F.filter(c, lambda x: x.rlike(f"[^{_SPACES}]")))
    repeats = F.when(F.size("unlike") < F.size("lines"), worded("lines") - worded("unlike")).otherwise(0)
    return rows.select(
        "doc_id",
        "n_words",
        (F.length("text") - F.regexp_count("text", F.lit(f"[{_SPACES}]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        repeats.cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        "h",
        *[x for x in rows.columns if x == "rest"],
    )


def judge(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A verdict on every row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    ``base_failed``: fewer than 50 words, or over half of the words in 3-word windows found twice or more in the text.
    ``kept``: not ``base_failed``, and a mean log ratio (``score``) of at least ``THRESHOLD``. Columns named in
    ``keep`` follow.

    Null and empty texts have no words, score 0 and fail the base rules. Null and repeated ids are judged row by row. If no trusted row
    has text, all ratios are 0 and only the base rules decide. An empty table gives an empty one; columns may have
    any names. Very long texts are judged whole, one row at a time.
    """
    table = F.split(F.lit(bucket_ratios(df, trusted, id_col, text_col)), ",").cast("array<int>")  # folded to one constant
    rest = F.struct(F.lit(0).alias("_"), *[F.col(x).alias(f"c{k}") for k, x in enumerate(keep)]).alias("rest")
    rows = base_columns(_hashed(df, id_col, text_col, (rest,)))
    total = lambda grams: F.aggregate(grams, F.lit(0).cast("long"), lambda a, x: a + F.get(table, _bucket(x)))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    rows = rows.withColumn("score", (total(F.col("h")) + total(_pairs())) / (STEPS * n))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")
    kept = ~F.col("base_failed") & (F.col("score") >= THRESHOLD)
    verdict = F.struct(*[F.col(x) for x in names], kept.alias("kept"), *[F.col(f"rest.c{k}").alias(f"c{k}") for k in range(len(keep))])
    # a generator of one row: a filter on the verdict stays above it and doesn't take its whole computation into the lambdas
    rows = rows.select(F.inline(F.array(verdict)))
    return rows.select(*names, "kept", *[F.col(f"c{k}").alias(x) for k, x in enumerate(keep)])
