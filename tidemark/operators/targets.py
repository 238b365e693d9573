"""Prediction targets: what the price does after each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .decoder import turning_points
from .running import asof, running


def fixed_horizon(frame: DataFrame, horizon: float, *, price: str = "price", keep: Column | None = None, block: float = 86400.0) -> DataFrame:
    """Adds ``pct_change_<horizon>``: relative change to the first row ``horizon`` later or after; NULL at the end.

    ``keep`` picks the rows that get a target; all rows can be matched.
    """
    left = frame if keep is None else frame.where(keep)
    out = asof(left, frame.select("ticker", "ts", F.col(price).alias("price")), F.col("ts") + horizon, block=block)
    return out.withColumn(f"pct_change_{horizon:g}", F.try_divide("matched", F.nullif(F.col(price), F.lit(0.0))) - 1).drop("matched", "matched_ts")


def wave_segments(frame: DataFrame, extremes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with seg (extremes up to and at the row), state and the segment's next extremes."""
    order = Window.partitionBy(*keys).orderBy("ts")
    marks = extremes.select(*keys, "ts", F.col("flag").alias("e_flag"), F.col("price").alias("e_price"))
    marks = marks.withColumns({"seg": F.row_number().over(order), "next_ts": F.lead("ts").over(order), "next_flag": F.lead("e_flag").over(order), "after_price": F.lead("e_price", 2).over(order)})
    marks = marks.select(*keys, "ts", F.struct("seg", F.col("ts").alias("from_ts"), "e_flag", "next_ts", "next_flag", "after_price").alias("m"))
    return asof(frame, marks, F.col("ts"), forward=False, keys=keys, value="m").select(*frame.columns, "matched.*")


def _ahead(rows: DataFrame, maxes: dict[str, Column], mins: dict[str, Column], keys: tuple[str, ...]) -> DataFrame:
    """Adds greatest and least values from each row to its segment's end: a running extreme backwards in time, over blocks."""
    back = rows.withColumns({"__back": -F.col("ts"), "__last": -F.col("seq")})
    return running(back, maxes=maxes, mins=mins, keys=keys, order=("__back", "__last")).drop("__back", "__last")


def wave_target(frame: DataFrame, *, price: str = "price", level: int = 4, keys: tuple[str, ...] = ("ticker",), smooth: bool = True, alpha: float = 0.008, look_back: float = 900.0) -> DataFrame:
    """Adds state, local_max, local_min, {up,down,target}_actual and, with ``smooth``, their smoothed forms.

    Between two extremes of ``level``, each row looks at the highest and lowest price up to the next extreme,
    that row included; a row at an extreme belongs to the later segment. Near an extreme that has another after
    it, the probability of holding on falls with the loss still ahead, and blends in the next segment's gain.
    """
    extremes = turning_points(frame, level, keys=keys, price=price).where(F.col("level") == level).groupBy(*keys, "ts").agg(F.max_by("price", F.col("flag")).alias("price"), F.max("flag").alias("flag"))
    rows = written(wave_segments(frame, written(extremes, "extremes"), keys), "segments")
    p = F.col(price)
    # the row at a segment's start also ends the one before
    both = F.when(F.col("ts") == F.col("from_ts"), F.array(F.col("seg"), F.col("seg") - 1)).otherwise(F.array("seg"))
    spread = rows.withColumn("s", F.explode(both))
    own = _ahead(spread, {"local_max": p}, {"local_min": p}, (*keys, "s")).where("s = seg OR seg IS NULL").drop("s")
    before = rows.where("seg IS NULL").select(*rows.columns, F.lit(None).cast("double").alias("local_max"), F.lit(None).cast("double").alias("local_min"))
    own = own.where("seg IS NOT NULL").unionByName(before)
    up, down = F.try_divide("local_max", p) - 1, F.try_divide("local_min", p) - 1
    own = own.withColumns({"state": F.coalesce(-F.col("e_flag"), F.lit(0)), "up_actual": up, "down_actual": down})
    own = own.withColumn("target_actual", F.when(F.col("state") == 1, F.col("up_actual")).when(F.col("state") == -1, F.col("down_actual")).otherwise(F.col("up_actual") + F.col("down_actual")))
    actual = [*frame.columns, "state", "local_max", "local_min", "up_actual", "down_actual", "target_actual"]
    if not smooth:
        return own.select(*actual)

    # each row once for its own segment's end, whose bounds it has, and at an extreme also for the end of the segment before
    own = written(own, "actual")
    bounds = {"w_from": "from_ts", "w_end": "next_ts", "w_flag": "next_flag", "w_after": "after_price"}
    near = (F.col("ts") >= F.greatest("w_from", F.col("w_end") - look_back)) & (F.col("ts") <= F.col("w_end")) & F.col("w_after").isNotNull()
    for k in keys:
        near = near & F.col(k).isNotNull()
    here = own.select("*", F.col("seg").alias("s"), *(F.col(c).alias(n) for n, c in bounds.items())).withColumn("near", F.coalesce(near, F.lit(False)))
    starts = own.where("ts = from_ts")
    ends = starts.select(*keys, F.col("seg").alias("s"), *(F.col(c).alias(n) for n, c in bounds.items())).distinct()
    before = starts.withColumn("s", F.col("seg") - 1).join(ends, [*keys, "s"]).where(near).withColumn("near", F.lit(True))
    worst = F.when(F.col("w_flag") == -1, F.col("down_actual")).otherwise(-F.col("up_actual"))
    part = written(_ahead(here.where("near").unionByName(before), {}, {"loss": worst}, (*keys, "s")), "losses")
    least = written(part.groupBy(*keys, "s").agg(F.greatest(F.min("loss"), F.lit(-alpha)).alias("thr")), "thresholds")
    hold = F.when(F.col("loss") > F.col("thr"), 1 - F.try_divide("loss", "thr")).otherwise(0.0)
    change = F.try_divide("w_after", p) - 1
    gain = F.when(F.col("w_flag") == -1, F.greatest(change, F.lit(0.0))).otherwise(F.least(change, F.lit(0.0)))
    part = part.join(least, [*keys, "s"]).withColumn("a", F.struct(F.col("w_flag").alias("flag"), hold.alias("h"), gain.alias("g")))
    # few rows lie at extremes, so only these are joined back; the others have their end beside them
    ended = written(part.where("s <> seg").groupBy(*keys, "ts", "seq").agg(F.max("a").alias("b")), "ended")
    far = here.where("NOT near").withColumn("a", F.lit(None).cast(part.schema["a"].dataType))
    out = part.where("s = seg").select(*own.columns, "a").unionByName(far.select(*own.columns, "a")).join(ended, [*keys, "ts", "seq"], "left")

    def mix(c: str, rest: Column) -> Column:
        return F.col(f"{c}.h") * F.col(f"{c}.g") + (1 - F.col(f"{c}.h")) * rest

    state = {"up": F.col("up_actual"), "down": F.col("down_actual"), "target": F.col("target_actual")}
    for c in ("b", "a"):  # the earlier segment's end first
        low, high = F.col(f"{c}.flag") == -1, F.col(f"{c}.flag") == 1
        state = {"up": F.when(low, mix(c, F.col("up_actual"))).otherwise(state["up"]), "down": F.when(high, mix(c, F.col("down_actual"))).otherwise(state["down"]), "target": F.when(low, mix(c, state["down"])).when(high, mix(c, state["up"])).otherwise(state["target"])}
    return out.select(*actual, *(v.alias(f"{k}_smoothed") for k, v in state.items()))


def named_targets(frame: DataFrame, *, horizon: float = 900.0, level: int = 3, price: str = "price", keys: tuple[str, ...] = ("ticker",), alpha: float = 0.008, look_back: float = 900.0) -> DataFrame:
    """``frame`` with its targets by the names that predictions carry: pct_change_<horizon>, and of ``level`` state_<level>, {up,down,target}_{actual,smoothed}_<level>."""
    waves = wave_target(frame, price=price, level=level, keys=keys, alpha=alpha, look_back=look_back)
    ends = [c for c in waves.columns if c == "state" or c.endswith(("_actual", "_smoothed"))]
    named = waves.select(*frame.columns, *(F.col(c).alias(f"{c}_{level}") for c in ends))
    return fixed_horizon(written(named, "targets"), horizon, price=price)
