"""Overlays on trades, rule returns, and folds in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import free
from tidemark.operators.percentiles import exact_percentiles
from tidemark.operators.touches import first_touch


def banded_weight(score: Column, bands: list[tuple[float, float]]) -> Column:
    """The weight of the first band whose lower edge the score reaches; 0 below all and for no score."""
    found = F.lit(0.0)
    for edge, weight in reversed(bands):
        found = F.when(score >= edge, weight).otherwise(found)
    return found


def overlay_by_fold(trades: DataFrame, fold: str, net: str, weight: str) -> DataFrame:
    """Results with and without the weights, their paired mean difference, and what a weight of 0 vetoed."""
    x, w = F.col(net), F.col(weight)
    return trades.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("base"), F.sum(w * x).alias("overlay"), F.avg(w * x - x).alias("difference"),
        F.count_if((w == 0) & (x > 0)).alias("vetoed_winners"), F.count_if((w == 0) & (x <= 0)).alias("vetoed_losers"),
    )


def break_even(trades: DataFrame, key: str, gross: str, traded: str, costs: list[int]) -> DataFrame:
    """Highest cost level (in basis points) with a gain and lowest with a loss. The levels meet sums per key, not trades."""
    sums = trades.groupBy(key).agg(F.sum(gross).alias("g"), F.sum(traded).alias("v"))
    each = sums.withColumn("bps", F.explode(F.array(*map(F.lit, costs)))).withColumn("net", F.col("g") - F.col("bps") / 10000.0 * F.col("v"))
    return each.groupBy(key).agg(F.max(F.when(F.col("net") > 0, F.col("bps"))).alias("last_positive"), F.min(F.when(F.col("net") < 0, F.col("bps"))).alias("first_negative"))


def rule_returns(bars: DataFrame, key: str, time: str, price: str, position: str, cost: float) -> DataFrame:
    """`ret`: the position times the return to the next bar, less the cost of the position's change; null on the last bar."""
    w = Window.partitionBy(key).orderBy(time)
    change = F.abs(F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0)))
    return bars.withColumn("ret", F.col(position) * (F.lead(price).over(w) / F.col(price) - 1) - cost * change)


def fold_sums(rows: DataFrame, time: str, value: str, starts: list[int], length: int, embargo: int) -> DataFrame:
    """fold (its start), role, n, total: validation rows lie in [start, start + length), training rows before start - embargo.

    Rows are summed per time first, so that only one row a time meets the folds.
    """
    per = rows.groupBy(time).agg(F.count(F.lit(1)).alias("c"), F.sum(value).alias("s"))
    each = per.withColumn("fold", F.explode(F.array(*map(F.lit, starts))))
    t, fold = F.col(time), F.col("fold")
    role = F.when(t < fold - embargo, "train").when((t >= fold) & (t < fold + length), "valid")
    return each.withColumn("role", role).where("role is not null").groupBy("fold", "role").agg(F.sum("c").alias("n"), F.sum("s").alias("total"))


def tercile_classes(rows: DataFrame, key: str, value: str, train: Column, places: int) -> DataFrame:
    """`class` 0, 1 or 2 by the thirds (`lo`, `hi`; `tercile_lo`, `tercile_hi` where these names are taken) of the key's training rows, rounded to `places`; rows of keys without training rows, or with a null key, are left out, a null value has no class."""
    names = [free(f"tercile_{c}", rows) for c in ("key", "lo", "hi")]
    cuts = exact_percentiles(rows.where(train), [key], value, {"low": 1 / 3, "high": 2 / 3})
    cuts = cuts.select(F.col(f"`{key}`").alias(names[0]), *(F.round(c, places).alias(n) for c, n in zip(("low", "high"), names[1:], strict=True)))
    x, lo, hi = F.col(value), F.col(names[1]), F.col(names[2])
    found = rows.join(cuts, F.col(key) == F.col(names[0])).withColumn("class", F.when(x <= lo, 0).when(x <= hi, 1).when(x.isNotNull(), 2))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns if c.lower() != "class"), lo.alias("lo") if "lo" not in rows.columns else lo.alias("tercile_lo"), hi.alias("hi") if "hi" not in rows.columns else hi.alias("tercile_hi"), "class")


def trailing_exits(trades: DataFrame, bars: DataFrame, trade: str, key: str, time: str, multiple: float, levels: int = 3) -> DataFrame:
    """trade, time, reason, fill, stop of the first bar on which a trade (entry, exit, entry_price, stop, atr) is stopped; trades that never are have no row.

    The stop in force is the larger of the trade's own and its peak less `multiple` times its range; the peak is of the bars before. An open at or below it fills at the open.
    A null range leaves the own stop. The bar is found by jumping over blocks of bars, so a trade's life may be of any length (`levels` as in `first_touch`). Trade ids are unique, and so are the bars of a key and time.
    """
    range_ = multiple * F.col("atr")
    found = first_touch(trades, bars, trade, key, time, "entry", "exit", F.col("stop"), peak=F.col("entry_price"), trail=range_, levels=levels).where("below").select(trade, time, "peak")
    x = found.join(trades.select(trade, key, F.col("stop").alias("own"), "atr"), trade).join(bars.select(key, time, "open"), [key, time])
    x = x.withColumn("stop", F.greatest("own", F.col("peak") - range_))
    gap = F.col("open") <= F.col("stop")
    return x.select(trade, time, F.when(gap, "gap_stop").otherwise("intrabar_stop").alias("reason"), F.when(gap, F.col("open")).otherwise(F.col("stop")).alias("fill"), "stop")


def complete_folds(rows: DataFrame, key: str, time: str, length: int) -> DataFrame:
    """`rows` with `fold` (from 0) and its `start`, counted from the key's first time; rows of a fold whose end the key's times don't reach are left out."""
    span = rows.groupBy(F.col(key).alias("fold_key")).agg(F.min(time).alias("fold_first"), F.max(time).alias("fold_last"))
    x = rows.join(span, F.col(key).eqNullSafe(F.col("fold_key"))).withColumn("fold", F.floor((F.col(time) - F.col("fold_first")) / length))
    x = x.withColumn("start", F.col("fold_first") + F.col("fold") * length)
    return x.where(F.col("start") + length - 1 <= F.col("fold_last")).drop("fold_key", "fold_first", "fold_last")


def rolling_by_key(rows: DataFrame, key: str, time: str, ret: str, moved: str, warm_up: int, length: int, least: int = 3) -> DataFrame:
    """key, folds, passing, median, promoted: results over whole folds of `length` rows after `warm_up` rows of each key.

    A fold passes with a gain, gains above losses and `least` changes of position; a key is promoted when half its folds (at least three) pass and their median is positive.
    Rows of a key are bounded by the calendar.
    """
    i = F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1
    x = rows.withColumn("roll_i", i).where((F.col("roll_i") >= warm_up) & F.col(ret).isNotNull()).withColumn("fold", F.floor((F.col("roll_i") - warm_up) / length))
    r = F.col(ret)
    f = x.groupBy(key, "fold").agg(F.round(F.sum(r), 6).alias("total"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("up"), (-F.sum(F.when(r < 0, r).otherwise(0.0))).alias("down"), F.count_if(moved).alias("changes"), F.count(F.lit(1)).alias("n"))
    f = f.where(F.col("n") == length).withColumn("pass", (F.col("total") > 0) & (F.col("up") > F.col("down")) & (F.col("changes") >= least))
    out = f.groupBy(key).agg(F.count(F.lit(1)).alias("folds"), F.count_if("pass").alias("passing"), F.percentile("total", 0.5).alias("median"))
    enough = F.col("passing") >= F.greatest(F.lit(3), F.expr("(folds + 1) div 2"))
    return out.withColumn("promoted", enough & (F.col("median") > 0))
