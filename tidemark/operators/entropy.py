"""Covariance and spectral entropy of members' bar series.

Pair covariances are plain aggregates over aligned buckets; only the eigenvalues of the small matrix of one
evaluation time need a matrix library.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running


def covariance(bars: DataFrame, value: str, members: list[str] | None = None) -> DataFrame:
    """(a, b, cov, n): population covariance of every two members of an index over their common buckets.

    The result has a row for each pair of members, so ``members`` bounds it; without, all tickers are members.
    """
    bars = bars if members is None else bars.where(F.col("ticker").isin(*members))
    left = bars.select(F.col("ticker").alias("a"), "idx", F.col(value).alias("x"))
    right = bars.select(F.col("ticker").alias("b"), "idx", F.col(value).alias("y"))
    return left.join(right, "idx").where("a <= b").groupBy("a", "b").agg(F.covar_pop("x", "y").alias("cov"), F.count("*").alias("n"))


def spectral(matrix: np.ndarray) -> tuple[float, float]:
    """Entropy -sum(l * log2 l) over positive eigenvalues, and the same without the largest."""
    values = np.linalg.eigvalsh(matrix)
    terms = [-v * math.log2(v) for v in values if v > 1e-12]
    rest = [-v * math.log2(v) for v in np.delete(values, np.argmax(values)) if v > 1e-12]
    return float(sum(terms)), float(sum(rest))


#: Buckets of a block.
BLOCK = 4096


def _wide(bars: DataFrame, members: list[str], values: list[str]) -> DataFrame:
    """(idx, m<i>_<value>): a row for each bucket, members beside each other, gaps filled with a member's last value."""
    picked = [F.max(F.when(F.col("ticker") == m, F.col(v))).alias(f"m{i}_{v}") for v in values for i, m in enumerate(members)]
    rows = bars.groupBy("idx").agg(*picked).withColumns({"__one": F.lit(0), "seq": F.lit(0)})
    names = [f"m{i}_{v}" for v in values for i in range(len(members))]
    return running(rows, lasts={n: F.col(n) for n in names}, keys=("__one",), block=float(BLOCK), order=("idx", "seq")).select("idx", *names)


def rolling_moments(bars: DataFrame, members: list[str], values: list[str], n: int) -> DataFrame:
    """(idx, and of each value n_<value>, cov_<value>): how many of the last ``n`` buckets all members have, and their covariances over these.

    cov_<value> lists the population covariances of members i <= j, by i and j; a gap takes the member's last value. One
    row a bucket stands for all members and values. Windows slide inside blocks of buckets; a block starts with a copy
    of the ``n`` - 1 buckets before it, so a long series spreads over its blocks.
    """
    m = len(members)
    wide = _wide(bars, members, values)
    # buckets may be missing, so they are counted; blocks are of counted buckets
    w = Window.partitionBy("__b").orderBy("idx")
    parts = wide.withColumn("__b", F.floor(F.col("idx") / BLOCK))
    sizes = parts.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", (F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))  # a row for each block
    place = F.col("__before") + F.row_number().over(w) - 1
    size = max(BLOCK, n)
    at = parts.join(sizes, "__b").withColumn("__k", place).withColumn("__own", F.floor(F.col("__k") / size))
    halo = F.when(F.col("__k") % size > size - n, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array(F.col("__own")))
    copies = at.withColumn("__block", F.explode(halo))
    last = Window.partitionBy("__block").orderBy("__k").rowsBetween(-(n - 1), 0)
    whole = {v: F.greatest(*(F.col(f"m{i}_{v}").isNull().cast("int") for i in range(m))) == 0 if m > 1 else F.col(f"m0_{v}").isNotNull() for v in values}
    x = lambda v, i: F.when(whole[v], F.col(f"m{i}_{v}"))
    made = {f"n_{v}": F.count(F.when(whole[v], 1)).over(last) for v in values}
    made |= {f"cov_{v}": F.array(*(F.covar_pop(x(v, i), x(v, j)).over(last) for i in range(m) for j in range(i, m))) for v in values}
    return copies.withColumns(made).where("__block = __own").select("idx", *made)


def _spectra(m: int):
    """Column function: entropy and secondary entropy of the covariances of ``m`` members."""
    upper = np.triu_indices(m)

    @F.pandas_udf("first double, second double")
    def run(covs: pd.Series) -> pd.DataFrame:
        flat = np.array([np.asarray(c, float) for c in covs]).reshape(len(covs), len(upper[0]))
        square = np.zeros((len(flat), m, m))
        square[:, upper[0], upper[1]] = square[:, upper[1], upper[0]] = np.nan_to_num(flat)
        own = np.linalg.eigvalsh(square)
        terms = np.where(own > 1e-12, -own * np.log2(np.where(own > 1e-12, own, 1.0)), 0.0)
        return pd.DataFrame({"first": terms.sum(axis=1), "second": terms[:, :-1].sum(axis=1)})

    return run


def rolling_entropies(bars: DataFrame, members: list[str], names: dict[str, str], n: int) -> DataFrame:
    """(idx, ready, and of each name <name>_entropy, <name>_secondary_entropy) for every bucket.

    ``names`` are the columns of ``bars`` and what their entropies are called. Entropies are of the covariance over the
    last ``n`` buckets, NULL under three common values; ready: each member has ``n`` of the first column.
    """
    moments, spectra = rolling_moments(bars, members, list(names), n), _spectra(len(members))
    enough = {v: F.col(f"n_{v}") >= 3 for v in names}
    found = moments.select("idx", *(f"n_{v}" for v in names), *(spectra(F.col(f"cov_{v}")).alias(f"__{v}") for v in names))
    out = [F.when(enough[v], F.col(f"__{v}.{part}")).alias(f"{name}_{kind}") for v, name in names.items() for part, kind in (("first", "entropy"), ("second", "secondary_entropy"))]
    return found.select("idx", (F.col(f"n_{next(iter(names))}") == n).alias("ready"), *out)


def rolling_entropy(bars: DataFrame, members: list[str], value: str, n: int, name: str, align: str = "bucket") -> DataFrame:
    """(idx, <name>_entropy, <name>_secondary_entropy, ready) for every bucket, over the last ``n`` of each member.

    ``align="bucket"``: series share buckets, gaps take the member's last value. ``"position"``: the last n of
    each, from the right. Under three common values: NULL. ready: each member has n.
    """
    if align == "bucket":
        return rolling_entropies(bars, members, {value: name}, n).select("idx", f"{name}_entropy", f"{name}_secondary_entropy", "ready")
    upto = Window.partitionBy("ticker").orderBy("idx")
    grid = bars.select("idx").distinct().select("idx", F.explode(F.array(*map(F.lit, members))).alias("ticker"))
    rows = grid.join(bars.where(F.col("ticker").isin(*members)).select("ticker", "idx", F.col(value).alias("x")), ["ticker", "idx"], "left")
    own = rows.where("x IS NOT NULL").withColumn("xs", F.collect_list("x").over(upto.rowsBetween(-(n - 1), 0)))
    held = grid.join(own.select("ticker", "idx", "xs"), ["ticker", "idx"], "left")
    series = held.withColumn("xs", F.coalesce(F.last("xs", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0)), F.array().cast("array<double>")))
    names = [f"{name}_entropy", f"{name}_secondary_entropy"]

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        xs = [np.asarray(x, float) for x in pdf.sort_values("ticker")["xs"]]
        k = min(map(len, xs))
        pair = spectral(np.cov(np.vstack([x[-k:] for x in xs]), ddof=0).reshape(len(xs), -1)) if k >= 3 else (None, None)
        return pd.DataFrame({"idx": [pdf["idx"].iloc[0]], names[0]: [pair[0]], names[1]: [pair[1]], "ready": [all(len(x) == n for x in xs)]})

    return series.select("idx", "ticker", "xs").groupBy("idx").applyInPandas(evaluate, f"idx long, {names[0]} double, {names[1]} double, ready boolean")


def relative_change(bars: DataFrame, value: str) -> DataFrame:
    """``bars`` with ``<value>_change``, the relative change from the ticker's bar before."""
    before = F.lag(value).over(Window.partitionBy("ticker").orderBy("idx"))
    return bars.withColumn(f"{value}_change", F.try_divide(F.col(value) - before, F.nullif(before, F.lit(0.0))))


def buy_share() -> Column:
    """Share of buys in a bar's notional (columns notional_buy, notional_sell); without either, one half."""
    total = F.col("notional_buy") + F.col("notional_sell")
    return F.coalesce(F.try_divide("notional_buy", F.nullif(total, F.lit(0.0))), F.lit(0.5))
