"""The corpus pipeline: documents in, token ids of the kept and cleaned ones out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm import decontaminate, pieces, pii, quality, simhash
from tideloom.llm.common import bounded_batches, put_back, set_aside, written
from tideloom.llm.queries import PIECES, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the classifier doesn't reject; it learns from the labels of the documents it gets.

    Null and empty texts are scored as empty, repeated rows alike. Without labels nothing can be rejected as bad.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own, now = set_aside(docs, "doc_id", "text")
    return put_back(quality.score(own, model, "_score").filter(F.col("_score") >= quality.THRESHOLD), now)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Groups are those of the near-duplicate operator with its own shingle length and bit distance. Null and empty texts are one group,
    repeated rows become one row; rows without doc_id go unless no row of their group has one.
    """
    bounded_batches(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents into which no benchmark item has leaked. Null and empty texts hold none; repeated rows stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. Null texts stay null; repeated rows stay."""
    bounded_batches(spark)
    return pii.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids in ``ids`` and the text that these decode to in ``decoded``.

    Null and empty texts have no ids. Columns of the documents that have these names already are replaced.
    """
    bounded_batches(spark)
    # written between, so that a task holds one Python worker with the codec, not two
    return pieces.decode(written(pieces.encode(docs, PIECES), "encoded"), PIECES)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None  # SQL can express none of the models


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
