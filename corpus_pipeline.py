"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, packing.

Each stage is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, packing, quality, simhash
from tidemark.llm.store import columns, documents, materialize, small_batches


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, with all their columns.

    Null and empty texts fail, so they go. Repeated rows are judged alike; ratios that tie with a threshold stay.
    """
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, or nearly, go from the texts; n_chars follows.

    Null texts stay null, and a text may become empty. Null doc_ids come first; repeated rows stand at one place, so
    they keep their lines.
    """
    out = line_dedup.dedup_lines(docs).select(*columns(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id's.

    Null and empty texts are one group. Null doc_ids come last; of ties and repeated rows one stays.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences.

    Null texts are empty: one piece with the end id. Repeated rows each get pieces. An empty table gives no pieces.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_repeated_lines), ("simhash_near_dedup", keep_one_of_group), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
