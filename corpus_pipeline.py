"""Five stages from documents to pieces; each works on all that the one before it kept.

Every stage's rows are written as Parquet in the shared folder and read again, so that a lost executor costs no more
than the tasks it ran, and no later stage repeats an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import decontamination, jaccard_join, quality_classifier, secret_scan, sentencepiece_codec
from loamwork.llm.shared import stored
from loamwork.sources.package import ship
from loamwork.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts; it learns from the labels of the documents that are here.

    A null or empty text is judged like any other, by the bias alone; repeated rows get equal verdicts; no rows give none.
    """
    model = quality_classifier.trained_model(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar texts, the one with the least id, null before all.

    Rows are told apart by id and text; those that repeat both are one document, of which one row stays. Texts without
    a word are similar to nothing.
    """
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark, with other numbers or names either; null ids and repeated ids are rows like any."""
    return decontamination.benchmark_free(docs, table(spark, sf_dir, "benchmark"))


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked that are no widely copied examples, and their lengths counted again, 0 for null texts."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' pieces and N-best scores, with whether decoding restores the text; null texts have null pieces."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", secret_free),
    ("SentencePiece encoding and decoding", pieces),
]

#: The first and the last stage can't be written in SQL; the tests hold the run against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i + 1}", "zstd")
    return docs
