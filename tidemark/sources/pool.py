"""Factor store: long rows (market_date, ts, factor, value) in Parquet by date, wide CSV at the border."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import asof

FACTORS = "ts double, factor string, value double"


def floor_ts(interval: float) -> Column:
    return F.floor(F.col("ts") / interval) * interval


def dated(factors: DataFrame) -> DataFrame:
    return factors.withColumn("market_date", F.to_date(F.timestamp_seconds("ts")))


def latest_cells(factors: DataFrame, order: str = "version") -> DataFrame:
    """One row for each (ts, factor): the last written."""
    return factors.groupBy("ts", "factor").agg(F.max_by("value", F.col(order)).alias("value"))


def upsert(stored: DataFrame, new: DataFrame, *, interval: float | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``stored`` with the cells of ``new`` over it; new times are floored to ``interval``, the latest of a cell counts."""
    rows = new.where(F.col("factor").isin(include)) if include else new
    rows = rows.where(~F.col("factor").isin(exclude)) if exclude else rows
    at = floor_ts(interval).alias("ts") if interval else F.col("ts")
    version = lambda n: F.struct(F.lit(n).alias("n"), F.col("ts"), F.col("value")).alias("version")
    both = stored.select("ts", "factor", "value", version(0)).unionByName(rows.select(at, "factor", "value", version(1)))
    return latest_cells(both)


def write(factors: DataFrame, path: str) -> None:
    """Replaces the dates that ``factors`` holds, and no others."""
    dated(factors).repartition("market_date").sortWithinPartitions("ts", "factor").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market_date").parquet(path)


def read(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(F.col("market_date") >= F.lit(start)) if start else df
    return df.where(F.col("market_date") <= F.lit(end)) if end else df


def names(factors: DataFrame) -> DataFrame:
    return factors.select("factor").distinct()


def last_dates(factors: DataFrame, upto: Column, n: int = 5, exclude_current: bool = False) -> DataFrame:
    """The last n dates with factors up to a date."""
    kept = F.col("market_date") < upto if exclude_current else F.col("market_date") <= upto
    return factors.where(kept).select("market_date").distinct().orderBy(F.desc("market_date")).limit(n)


def wide(factors: DataFrame, columns: list[str]) -> DataFrame:
    """One column a factor, sorted by name; the names are given, so no pass finds them."""
    return factors.groupBy("ts").pivot("factor", sorted(columns)).agg(F.first("value", ignorenulls=True))


def export_csv(factors: DataFrame, path: str, columns: list[str]) -> None:
    """Wide CSV by date, empty for missing, times ascending within a date."""
    out = wide(factors, columns).withColumnRenamed("ts", "Timestamp")
    out = out.withColumn("market_date", F.date_format(F.timestamp_seconds("Timestamp"), "yyyyMMdd"))
    out.repartition("market_date").sortWithinPartitions("Timestamp").write.mode("overwrite").partitionBy("market_date").option("header", True).csv(path)


def import_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(ts, factor, value) of wide CSV files; empty cells give no row. A missing folder gives no rows."""
    from pyspark.errors import AnalysisException

    schema = T.StructType([T.StructField("Timestamp", T.DoubleType()), *(T.StructField(c, T.DoubleType()) for c in sorted(columns))])
    try:
        df = spark.read.schema(schema).csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FACTORS)
    return df.unpivot(["Timestamp"], [F.col(f"`{c}`") for c in sorted(columns)], "factor", "value").where("value IS NOT NULL").withColumnRenamed("Timestamp", "ts")


def playback(clock: DataFrame, factors: DataFrame, columns: list[str], *, forward: bool = False, strict: bool = False) -> DataFrame:
    """(ts, matched_ts, factors as a map) as a clock sees the store: the row at or before each time.

    ``forward`` with ``strict`` shows the first row after it instead, which looks ahead; past the end, NULL.
    """
    rows = wide(factors, columns).select(F.lit(0).alias("k"), "ts", F.map_filter(F.create_map(*(x for c in sorted(columns) for x in (F.lit(c), F.col(f"`{c}`")))), lambda _, v: v.isNotNull()).alias("m"))
    times = rows.select("k", "ts", F.col("ts").alias("at"))
    found = asof(clock.select(F.lit(0).alias("k"), "ts"), times, F.col("ts"), keys=("k",), value="at", forward=forward, strict=strict)
    return found.select("ts", "matched_ts").join(rows.select(F.col("ts").alias("matched_ts"), "m"), "matched_ts", "left").select("ts", "matched_ts", F.col("m").alias("factors"))


def lookup(wanted: DataFrame, keys: DataFrame, step: float) -> DataFrame:
    """(ts, found): the first of ``keys`` at or after each time; without one, the time floored to ``step``."""
    right = keys.select(F.lit(0).alias("k"), "ts", F.col("ts").alias("v"))
    out = asof(wanted.select(F.lit(0).alias("k"), "ts"), right, F.col("ts"), keys=("k",), value="v")
    return out.select("ts", F.coalesce("matched", F.floor(F.col("ts") / step) * step).alias("found"))
