"""Weights, composites and synthetic indices."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def weights_from_json(spark: SparkSession, text: str) -> DataFrame:
    """(index_name, ticker, weight) of {"index_name": ..., "weights": {ticker: weight}}; weights must be positive."""
    spec = json.loads(text)
    bad = [t for t, w in spec["weights"].items() if not w > 0]
    if bad:
        raise ValueError(f"weights must be positive: {bad}")
    return spark.createDataFrame([(spec["index_name"], t, float(w)) for t, w in spec["weights"].items()], "index_name string, ticker string, weight double")


def normalize(weights: DataFrame) -> DataFrame:
    """Weights that add up to one within an index; a zero total leaves them."""
    total = F.sum("weight").over(Window.partitionBy("index_name"))
    return weights.withColumn("weight", F.when(total == 0, F.col("weight")).otherwise(F.try_divide("weight", total)))


def composite(weights: DataFrame, values: DataFrame, value: str, *, by: tuple[str, ...] = (), replace_na: float | None = 0.0, name: str = "composite") -> DataFrame:
    """Sum of weight * value by index and ``by``; members without a value count as ``replace_na``.

    With ``by``, members missing from a group are added through the group's weight that is absent, so nothing is
    crossed: sum(w * v) + replace_na * (total weight - weight present).
    """
    total = weights.groupBy("index_name").agg(F.sum("weight").alias("__all"))
    rows = weights.join(values, "ticker")
    present = F.when(F.col(value).isNotNull(), F.col("weight"))
    out = rows.groupBy("index_name", *by).agg(F.sum(F.col("weight") * F.col(value)).alias("__s"), F.sum(present).alias("__w"))
    missing = F.col("__all") - F.coalesce("__w", F.lit(0.0))
    score = F.coalesce("__s", F.lit(0.0)) + (F.lit(replace_na) * missing if replace_na is not None else 0.0)
    if replace_na is None:
        score = F.when(F.abs(missing) <= 1e-9 * F.col("__all"), score)
    return out.join(total, "index_name").select("index_name", *by, score.alias(name))


def synthetic_index(tape: DataFrame, weights: DataFrame, *, base: float = 1.0, missing: str = "one") -> DataFrame:
    """(index_name, level): base times the weighted mean of last price over first.

    ``missing="one"``: a member never seen counts as unchanged; "renormalize": it carries no weight.
    """
    at = F.struct("ts", "seq")
    last = tape.groupBy("ticker").agg(F.try_divide(F.max_by("price", at), F.nullif(F.min_by("price", at), F.lit(0.0))).alias("ratio"))
    rows = weights.join(last, "ticker", "left")
    if missing == "one":
        level = F.sum(F.col("weight") * F.coalesce("ratio", F.lit(1.0))) / F.sum("weight")
    else:
        level = F.try_divide(F.sum(F.col("weight") * F.col("ratio")), F.sum(F.when(F.col("ratio").isNotNull(), F.col("weight"))))
    return rows.groupBy("index_name").agg((level * base).alias("level"))


def index_bars(bars: DataFrame, weights: DataFrame, base_price: DataFrame) -> DataFrame:
    """(index_name, idx, open, high, low, close, volume, notional, n_trades): bars of members, prices over the base composite.

    Only buckets in which every member has a bar give prices; sums cover the members that traded.
    """
    n = weights.groupBy("index_name").agg(F.count("*").alias("n"))
    base = weights.join(base_price, "ticker").groupBy("index_name").agg(F.sum(F.col("weight") * F.col("base")).alias("b"))
    rows = weights.join(bars, "ticker")
    price = {c: F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("open", "high", "low", "close")}
    out = rows.groupBy("index_name", "idx").agg(F.count("*").alias("members"), *price.values(), *(F.sum(c).alias(c) for c in ("volume", "notional", "n_trades")))
    out = out.join(n, "index_name").join(base, "index_name")
    return out.select("index_name", "idx", *(F.when(F.col("members") == F.col("n"), F.try_divide(c, "b")).alias(c) for c in price), "volume", "notional", "n_trades")
