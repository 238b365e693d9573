"""EMA, MACD and trend: recurrences over a key's ordered bars.

An EMA is affine in the memory it starts from. A key's bars are cut into blocks by their order; every block is folded
from an empty memory inside Spark's own expressions, a key's few blocks are folded in turn for the memory that each
starts with, and that is joined back and added, with its weight. So no key's bars stand in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Retention of a step, so that after 60 steps a half, a fifth, a tenth, a hundredth and a thousandth remain.
RETENTION = {"0.5": 0.9885, "0.2": 0.9735, "0.1": 0.9624, "0.01": 0.9261, "0.001": 0.8913}
#: Width of a block in the order's unit.
BLOCK = 1024
ALPHA = {k: 1 - v for k, v in RETENTION.items()}


def alpha_of(window: int) -> float:
    return 2 / (window + 1)


def _blocks(df: DataFrame, value: str, alphas: dict[str, float], keys: tuple[str, ...], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, __b, rows, and of each name its series from an empty memory); NULLs are passed over."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x"), *keep)))
    cut = df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(order) / BLOCK).alias("__b")).agg(rows.alias("rows"))
    start = F.struct(F.lit(0.0).alias("m"), F.array().cast("array<double>").alias("s"))

    def series(alpha: float) -> Column:
        def step(acc: Column, row: Column) -> Column:
            new = alpha * row["x"] + (1 - alpha) * acc["m"]
            return F.struct(new.alias("m"), F.concat(acc["s"], F.array(new)).alias("s"))

        return F.aggregate("rows", start, step)["s"]

    return cut.select(*keys, "__b", "rows", *(series(a).alias(f"__{n}") for n, a in alphas.items()))


def _starts(blocks: DataFrame, alphas: dict[str, float], keys: tuple[str, ...], seed: float | None) -> DataFrame:
    """(keys, s): the blocks of a key in order, with the memories that each starts with; ``first`` marks the first."""
    ends = blocks.select(*keys, F.struct("__b", F.size("rows").alias("n"), F.get("rows", F.lit(0))["x"].alias("x"), *(F.element_at(f"__{n}", -1).alias(n) for n in alphas)).alias("e"))
    kinds = ", ".join(f"{n}: double" for n in alphas)
    blank = F.struct(*(F.lit(seed).cast("double").alias(n) for n in alphas), F.array().cast(f"array<struct<__b: bigint, first: boolean, {kinds}>>").alias("s"))

    def step(acc: Column, e: Column) -> Column:
        memory = {n: F.coalesce(acc[n], e["x"]) for n in alphas}
        after = [(e[n] + F.pow(F.lit(1 - a), e["n"]) * memory[n]).alias(n) for n, a in alphas.items()]
        here = F.struct(e["__b"].alias("__b"), (F.size(acc["s"]) == 0).alias("first"), *(m.alias(n) for n, m in memory.items()))
        return F.struct(*after, F.concat(acc["s"], F.array(here)).alias("s"))

    return ends.groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("e")).select(*keys, F.aggregate("e", blank, step).alias("z"))


def emas(df: DataFrame, value: str, alphas: dict[str, float], *, keys: tuple[str, ...] = ("ticker",), order: str = "idx", seed: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, order, x, first, keep, one column a name): several EMAs of one value; ``first`` marks a key's first row."""
    blocks = _blocks(df, value, alphas, keys, order, keep)
    starts = _starts(blocks, alphas, keys, seed).select(*keys, F.explode("z.s").alias("z")).select(*keys, F.col("z.__b").alias("__b"), F.col("z.first").alias("__first"), *(F.col(f"z.{n}").alias(f"__m_{n}") for n in alphas))
    joined = blocks.join(starts, [*keys, "__b"])
    each = joined.select(*keys, "__first", *(f"__m_{n}" for n in alphas), F.posexplode(F.arrays_zip("rows", *(f"__{n}" for n in alphas))).alias("__i", "z"))
    values = (F.col(f"z.__{n}") + F.pow(F.lit(1 - a), F.col("__i") + 1) * F.col(f"__m_{n}") for n, a in alphas.items())
    return each.select(*keys, F.col("z.rows.o").alias(order), F.col("z.rows.x").alias("x"), (F.col("__first") & (F.col("__i") == 0)).alias("first"), *(F.col(f"z.rows.{k}").alias(k) for k in keep), *(v.alias(n) for n, v in zip(alphas, values, strict=True)))


def ema_series(df: DataFrame, value: str, alpha: float, *, keys: tuple[str, ...] = ("ticker",), order: str = "idx", seed: float | None = None, emit_seed: bool = True) -> DataFrame:
    """(keys, order, ema): alpha * x + (1 - alpha) * memory, from the first value or ``seed``. NULLs are passed over.

    ``emit_seed=False``: the first value's row is NULL, as it only fills the memory.
    """
    out = emas(df, value, {"ema": alpha}, keys=keys, order=order, seed=seed)
    return out.select(*keys, order, F.when(~F.col("first") | F.lit(emit_seed or seed is not None), F.col("ema")).alias("ema"))


def ema_last(df: DataFrame, value: str, alpha: float, *, keys: tuple[str, ...] = ("ticker",), order: str = "idx") -> DataFrame:
    """(keys, ema): the memory after the last value."""
    alphas = {"ema": alpha}
    return _starts(_blocks(df, value, alphas, keys, order), alphas, keys, None).select(*keys, F.col("z.ema").alias("ema"))


def macd(df: DataFrame, price: str = "close", *, short: int = 12, long: int = 26, signal: int = 9, keys: tuple[str, ...] = ("ticker",), order: str = "idx") -> DataFrame:
    """(keys, order, line, signal, diff, diff_adjusted); all memories start at the first price, the signal at the first line."""
    both = emas(df, price, {"f": alpha_of(short), "g": alpha_of(long)}, keys=keys, order=order)
    line = both.select(*keys, order, F.col("x").alias("price"), (F.col("f") - F.col("g")).alias("line"))
    out = emas(line, "line", {"signal": alpha_of(signal)}, keys=keys, order=order, keep=("price",))
    diff = F.col("x") - F.col("signal")
    return out.select(*keys, order, F.col("x").alias("line"), "signal", diff.alias("diff"), F.try_divide(diff, "price").alias("diff_adjusted"))


def snapshot(df: DataFrame, value: str, alpha: float, *, keys: tuple[str, ...] = ("ticker",), order: str = "idx") -> DataFrame:
    """(keys, state): each key's memory and the place it has come to, as JSON."""
    last = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(order).alias("at"))
    return ema_last(df, value, alpha, keys=keys, order=order).join(last, list(keys)).select(*keys, F.to_json(F.struct(F.lit(alpha).alias("alpha"), "at", F.col("ema").alias("memory"))).alias("state"))


def resume(df: DataFrame, value: str, states: DataFrame, alpha: float, *, keys: tuple[str, ...] = ("ticker",), order: str = "idx") -> DataFrame:
    """(keys, order, ema) of the rows after each key's snapshot, going on from its memory; keys without one start anew."""
    held = states.select(*keys, F.from_json("state", "alpha double, at double, memory double").alias("h"))
    rows = df.join(held, list(keys), "left").where(F.col("h").isNull() | (F.col(order) > F.col("h.at")))
    # the memory is one row before the first: its EMA from an empty start is the memory itself
    before = held.join(rows.select(*keys).distinct(), list(keys)).select(*keys, F.col("h.at").cast(df.schema[order].dataType).alias(order), F.col("h.memory").alias(value), F.lit(True).alias("__held"))
    both = rows.select(*keys, order, value, F.lit(False).alias("__held")).unionByName(before)
    out = ema_series(both, value, alpha, keys=keys, order=order)
    return out.join(before.select(*keys, order), [*keys, order], "left_anti")


def trend(bars: DataFrame, alpha: float, price: str = "close", keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, idx, trend): EMA of the relative change between closed bars; the open bar is left out."""
    w = Window.partitionBy(*keys)
    closed = bars.withColumn("open_idx", F.max("idx").over(w)).where("idx < open_idx")
    change = closed.withColumn("change", F.try_divide(price, F.nullif(F.lag(price).over(w.orderBy("idx")), F.lit(0.0))) - 1)
    return ema_series(change, "change", alpha, keys=keys).withColumnRenamed("ema", "trend")
