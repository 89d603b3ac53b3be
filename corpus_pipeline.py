"""A training corpus from raw documents: what language, which lines, near copies and benchmark passages go, and how the rest is
packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import language, leaks, lines, nearcopies, packing
from ledgerlens.llm.queries import vocabulary
from ledgerlens.sources.files import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language the compression leaves open, go."""
    return language.accepted(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted from the texts; every document stays, if need be with an empty text."""
    found = lines.deduplicated(docs)
    columns = {"text": F.col("left_text"), "n_chars": F.length("left_text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*(columns[c].alias(c) if c in columns else F.col("row").getField(c).alias(c) for c in docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first document stays; texts without words are in no group."""
    return nearcopies.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row, or a whole shorter item, with the benchmark go."""
    return leaks.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096: a row for each piece."""
    return packing.packed(docs, vocabulary())


STAGES = [("language", known_language), ("lines", without_repeated_lines), ("near copies", without_near_copies),
          ("benchmark", without_benchmark), ("packing", sequences)]

#: Compression, sketches and tokenizers have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
