"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but for the last, returns the
columns of ``docs``. Labels are read from ``sf_dir``; they train, and are no evidence for their own documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import pack, quality, rules, similar, substring
from gridloom.llm.common import shared_folder, table, written


def _hidden(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``doc_id, text`` and all other columns under names that no operator gives; and these names."""
    others = [x for x in docs.columns if x not in ("doc_id", "text")]
    names = tuple(f"own {k}" for k in range(len(others)))
    return docs.select("doc_id", "text", *[F.col(f"`{x}`").alias(y) for x, y in zip(others, names, strict=True)]), names


def _shown(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``doc_id, text`` and the hidden columns of ``docs`` under their names in ``like``, and in its order."""
    others = [x for x in like.columns if x not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *[F.col(f"`own {k}`").alias(x) for k, x in enumerate(others)]).select(*[F.col(f"`{x}`") for x in like.columns])


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more.

    Null and empty texts have empty features and are scored like any other; a score of exactly 0.5 stays. Null and
    repeated ids and repeated rows are judged each by its text. An empty table gives an empty one. Columns stay as they are, whatever
    their names; a very long text is read whole.
    """
    hidden, names = _hidden(docs)
    scored = quality.classify(hidden, table(spark, sf_dir, "labels"), keep=("text", *names))
    return _shown(scored.filter("predicted = 1"), docs)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams are as likely in trusted text.

    Null and empty texts fail, as they have too few words; a score at the threshold stays. Null and repeated ids and repeated rows are
    judged each. An empty table gives an empty one. Columns stay as they are, whatever their names; a very long text is judged whole.
    """
    hidden, names = _hidden(docs)
    judged = rules.judge(hidden, table(spark, sf_dir, "labels").filter("quality = 1"), keep=("text", *names))
    return _shown(judged.filter("kept"), docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Null and empty texts are one group. Rows without an id stand behind those with one; of rows that repeat an id and a text one
    stays, of different texts of one id each group's. An empty table gives an empty one. Columns stay as they are, whatever their
    names; very long texts are compared whole.
    """
    return similar.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 and more words that a document with a smaller id holds; ``n_chars``, if there, follows.

    Null texts become empty; texts that lose all words stay as empty ones. Rows without an id lose nothing; rows that share an id
    are not earlier than each other. An empty table gives an empty one. Other columns stay as they are, whatever their names;
    very long texts are parsed whole.
    """
    hidden, names = _hidden(docs)
    kept = _shown(substring.remove_repeats(hidden, keep=names).withColumnRenamed("kept_text", "text"), docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens out of all texts that are left: a row per piece, as ``pack.pack`` gives it.

    Null and empty texts give their end alone; null and repeated ids and repeated rows are packed each. An empty table gives no
    piece. Other columns are not read, whatever their names; a very long text is cut into full sequences.
    """
    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", classified), ("quality rules", ruled), ("SimHash near-dedup", deduplicated), ("substring dedup", without_repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs


#: The classifier and the likelihoods have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
