"""Market regimes from several indicators, and the direction that rules take from them.

Bars of a key are bounded by the calendar. Cases: indicators that are not there yet make regime, side and directions null; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import free
from tidemark.operators import indicators as I
from tidemark.operators import recursive
from tidemark.operators.timeline import asof_join
from tidemark.sources.readers import written


@dataclass(frozen=True)
class Lengths:
    """Rows of each indicator."""

    strength: int = 14
    fast: int = 20
    slow: int = 50
    macd_fast: int = 12
    macd_slow: int = 26
    signal: int = 9


@dataclass(frozen=True)
class Limits:
    """Edges of the regimes."""

    volatile: float = 0.05
    trend: float = 25.0
    chop: float = 18.0
    gap: float = 0.002


def measured(bars: DataFrame, key: str, order: str, n: Lengths = Lengths()) -> DataFrame:
    """Bars with adx, atr_pct, fast, slow, macd, signal, histogram and rsi; columns of these names are replaced."""
    bars = bars.drop("fast", "slow", "macd", "signal", "histogram", "rsi", "adx", "atr_pct")
    R = recursive  # noqa: N806
    means = R.means_part([R.ema_spec("fast", "close", n.fast), R.ema_spec("slow", "close", n.slow)])
    x = R.together(bars, key, order, [means, R.rsi_part(bars, key, order, n.strength), R.adx_part(bars, key, order, n.strength), R.macd_part(bars, key, order, n.macd_fast, n.macd_slow, n.signal)])
    w = Window.partitionBy(key).orderBy(order)
    tr = free("measured_range", x)
    return x.withColumn(tr, I.true_range(w)).withColumn("atr_pct", I.sma(tr, n.strength, w) / F.col("close")).drop(tr)


def snapshots(measured_bars: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds `regime` (HIGH_VOLATILITY, TRENDING, SIDEWAYS) and `side` (buy or sell while trending, else null)."""
    c = F.col
    known = reduce(lambda a, b: a & b, (c(x).isNotNull() for x in ("adx", "atr_pct", "fast", "slow", "macd", "signal", "rsi")))
    apart = (c("adx") >= limits.trend) & (F.abs(c("fast") - c("slow")) / c("close") > limits.gap)
    aligned = F.when((c("fast") > c("slow")) & (c("macd") >= c("signal")) & (c("rsi") >= 50), "buy").when((c("fast") < c("slow")) & (c("macd") <= c("signal")) & (c("rsi") <= 50), "sell")
    moving = F.when((c("histogram") > 0) & (c("rsi") > 55), "buy").when((c("histogram") < 0) & (c("rsi") < 45), "sell")
    side = F.when(~known | (c("atr_pct") >= limits.volatile), None).when(apart, aligned).when(c("adx") <= limits.chop, None).otherwise(moving)
    regime = F.when(~known, None).when(c("atr_pct") >= limits.volatile, "HIGH_VOLATILITY").when(c("side").isNotNull(), "TRENDING").otherwise("SIDEWAYS")
    return measured_bars.withColumn("side", side).withColumn("regime", regime)


def directions(intraday: DataFrame, daily: DataFrame, key: str, closes_at: Column, day_closes_at: Column, ends_day: Column, lookback: int = 20, weeks: tuple[int, int] = (7, 14), allow_short: bool = True) -> DataFrame:
    """Adds to `intraday` snapshots the direction (buy, sell or null) of four rules: confluence, breakout, momentum, pullback.

    `daily` are snapshots of days; a bar sees the last day that had closed by its own close. `closes_at` and `day_closes_at` are seconds, `ends_day` says that a bar is its day's last.
    """
    at, ends = free("direction_at", intraday, daily), free("direction_ends", intraday)
    d = Window.partitionBy(key).orderBy(at)
    days = daily.withColumn(at, day_closes_at)
    days = days.select(
        key, at, F.col("close").alias("d_close"), F.lag("close", weeks[0]).over(d).alias("d_week"), F.lag("close", weeks[1]).over(d).alias("d_before"), *(F.col(x).alias(f"d_{x}") for x in ("fast", "slow", "macd", "signal", "rsi", "side"))
    )
    values = [c for c in days.columns if c.startswith("d_")]
    bars = intraday.withColumn(at, closes_at).withColumn(ends, ends_day)
    w = Window.partitionBy(key).orderBy(at)
    prior = I.last_rows(w, lookback, 1)
    bars = bars.withColumns({
        "prior_high": I.full(w, lookback, F.max("close").over(prior), 1), "prior_low": I.full(w, lookback, F.min("close").over(prior), 1), "last_close": F.lag("close").over(w), "last_fast": F.lag("fast").over(w),
    })
    x = asof_join(written(bars, "direction-bars"), written(days, "direction-days"), key, at, values)  # the join reads each several times
    c = F.col
    up = (c("d_close") >= c("d_week")) & (c("d_week") >= c("d_before"))
    down = (c("d_close") <= c("d_week")) & (c("d_week") <= c("d_before"))
    rising, falling = (c("d_fast") > c("d_slow")) & (c("d_macd") >= c("d_signal")), (c("d_fast") < c("d_slow")) & (c("d_macd") <= c("d_signal"))
    says = lambda p, side, low, high: F.coalesce(c(p + "side") == side, F.lit(False)) | ((c(p + "macd") >= c(p + "signal")) & (c(p + "rsi") >= low) if side == "buy" else (c(p + "macd") <= c(p + "signal")) & (c(p + "rsi") <= high))
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    bull, bear = (yes(says("d_", s, 52, 48)) & yes(says("", s, 52, 48)) for s in ("buy", "sell"))
    short = F.lit(allow_short)
    rules = {
        "confluence": F.when(bull & ~bear, "buy").when(bear & ~bull, "sell"),
        "breakout": F.when(yes(up & rising & (c("close") > c("prior_high"))), "buy").when(short & yes(down & falling & (c("close") < c("prior_low"))), "sell"),
        "momentum": F.when(c(ends) & yes(up & rising), "buy"),
        "pullback": F.when(yes(rising & (c("last_close") <= c("last_fast")) & (c("close") > c("fast"))), "buy"),
    }
    return x.withColumns(rules).drop(*values, at, ends, "prior_high", "prior_low", "last_close", "last_fast")
