"""Shared-folder tables that cut lineage, and the columns every operator starts from.

Intermediate results are Parquet tables in the folder named by ``spark.checkpoint.dir``: they survive the
loss of any executor, and later stages read only the columns they need.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of the helper columns, so that extra columns of the input never clash with them.
P = "__tm_"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; in local mode, where none is set, a temporary one of the application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tidemark-{spark.sparkContext.applicationId}"
    return base


def partitions_for(spark: SparkSession, n_bytes: int | None) -> int:
    """Partitions for so many bytes: the session's shuffle partitions, or more if each would pass its advisory size."""
    advisory = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_bytes or 0) // advisory))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns by their quoted names, which may hold dots and backticks."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows for this session: whole texts are long rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
