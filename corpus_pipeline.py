"""From raw documents to packed sequences, in five stages.

Each stage takes the documents that the one before kept, all of them, and returns
the rows it keeps with all their columns; the last returns token pieces with their
places in sequences.  Every stage's result is written as Parquet and read again, so
a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerframe.llm import exactdedup, langid, neardup, packing, quality
from ledgerframe.llm.common import crc_mod, cut, table, unused
from ledgerframe.llm.queries import word_bpe

#: Below this probability a text is not taken to be in any learned language (chance among four is 0.25).
LEAST_LANGUAGE_SCORE = 0.4

#: Trained models, hashing of samples and packing have no SQL form; tests/llm/test_pipeline.py holds the stages
#: against plain Python on small tables.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a learned language; without letters, null or of no clear language they go.

    Rows that repeat are judged alike and all stay or go; an empty table stays empty.
    """
    net = langid.fit_language(docs)
    whole = unused(docs.columns, "_in")
    named = langid.predict_language(docs.withColumn(whole, F.struct("*")), net, [whole])
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(f"{whole}.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that the quality trees score 0.7 or more.

    Null and empty texts are scored too; rows that repeat all stay or go; an empty table stays empty.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    whole = unused(docs.columns, "_in")
    scored = quality.score_quality(docs.withColumn(whole, F.struct("*")), model, [whole])
    return scored.where("predicted = 1").select(f"{whole}.*")


def kept_rows(docs: DataFrame, decisions: DataFrame, key: Column, key_name: str) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, ``key_name``, kept) keep.

    Of rows that repeat doc_id and text the one whose columns hash least stays.  The texts
    move once: to where their decision is, and repeated rows lie together there.
    """
    names = [unused(docs.columns, n) for n in ("_absent", "_number", "_key")]

    def placed(df: DataFrame, key: Column) -> DataFrame:
        of = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), key)
        return df.select("*", *[c.alias(n) for c, n in zip(of, names)])

    kept = placed(decisions.where("kept"), F.col(key_name)).select(*names)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    chosen = placed(docs, key).join(kept, names, "left_semi")
    one = chosen.groupBy(*names).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("one"))
    return one.select("one.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts (A-Z lower-cased; null counts as empty).

    A null doc_id is smaller than any other; an empty table stays empty.
    """
    found = exactdedup.dedup(docs.where(crc_mod("doc_id", 2) == 0), docs.where(crc_mod("doc_id", 2) == 1))
    return kept_rows(docs, found, exactdedup.text_key("text"), "text_sha256")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the smallest doc_id, of each class of near duplicates.

    Null and empty texts are one class; a null doc_id is larger than any other; an empty table stays empty.
    """
    return kept_rows(docs, neardup.near_duplicates(docs, threshold=0.8), neardup.text_key("text"), "text_key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of at most 4096 tokens.

    A null or empty text is its end id alone; rows that repeat are packed each; an empty table gives none.
    """
    return packing.pack_documents(docs, word_bpe(), end_id=1, capacity=4096)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
