"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm import lines, minhash, mixing, packing, quality
from quillet.llm.queries import PACKING_VOCABULARY, vocabulary
from quillet.session import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are near copies one stays; n_chars follows the text, and a document left without a line goes."""
    out = lines.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.where(mixing.sizes(F.col("text")) > 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.keep(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks; a repeat is a row of its own under the same doc_id."""
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place: doc_id, piece, start, length, ids_crc32, sequence_id and offset. Repeats are pieces too."""
    return packing.pack(docs, vocabulary(PACKING_VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixture),
    ("packing", packed),
]

#: Stages hash, sample and pack in ways that SQL can't express; a test replays them by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet into the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
