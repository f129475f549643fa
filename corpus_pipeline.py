"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

A stage works on all rows that its predecessor kept. All but the last return the columns of their input. Rows with null
texts count as empty; repeated rows are judged alike, and the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import language_id, near_copies, packing, quality_classifier, secret_scan
from tallyloom.llm.common import table
from tallyloom.session import written

VERDICT, LANGUAGE = "_pipeline_score", "_pipeline_language"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labelled ones among them, scores at its threshold or higher.

    All stay when it learned from fewer than two classes, which tell nothing about the others.
    """
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    if not model.tells_apart:
        return docs
    scored = quality_classifier.score(docs, model, *docs.columns, into=VERDICT)
    return scored.where(F.col(VERDICT) >= quality_classifier.THRESHOLD).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without a letter, or far below what the language's own documents score, go.

    Bounds follow from the documents and are lower for short texts.
    """
    profiles = language_id.learn(docs)
    predicted = language_id.predict(docs, profiles, *docs.columns, into=(LANGUAGE, VERDICT))
    own = reduce(lambda a, kv: F.when(F.col(LANGUAGE) == kv[0], kv[1]).otherwise(a), language_id.bounds(docs, profiles).items(), F.lit(0.0))
    least = own * language_id.expected(F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)))
    return predicted.where((F.col(LANGUAGE) != language_id.UNDETERMINED) & (F.col(VERDICT) >= least)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; documents without id stay.

    Near copies have a Jaccard similarity of 0.8 or more of their five-word shingles: SimHash fingerprints are compared
    by bit planes, and what is close is checked exactly. Of rows with one id the first by text stays, and only it is compared.
    """
    known = docs.where("doc_id is not null")
    several = written(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias(VERDICT)).where(F.col(VERDICT) > 1).select("doc_id"), "several")
    same_id = Window.partitionBy("doc_id").orderBy("text")
    first = known.join(several, "doc_id", "left_semi").withColumn(VERDICT, F.row_number().over(same_id)).where(F.col(VERDICT) == 1)
    one = known.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
    return one.join(near_copies.repeats(one), "doc_id", "left_anti").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the stretches of text in which a secret was found replaced by a mark."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of a fixed length."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("packing", pack),
]
#: models and encodings have no counterpart in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
