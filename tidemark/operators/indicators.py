"""Rolling indicators over bars: columns of the current and earlier rows of a key only, null until the window is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.names import free
from tidemark.operators.timeline import running_before


def last_rows(w: WindowSpec, n: int, skip: int = 0) -> WindowSpec:
    """The last n rows, the current one included unless `skip` leaves out the latest."""
    return w.rowsBetween(-(n - 1) - skip, -skip)


def full(w: WindowSpec, n: int, value: Column, skip: int = 0) -> Column:
    """`value` where n rows are there, else null."""
    return F.when(F.count(F.lit(1)).over(last_rows(w, n, skip)) == n, value)


def sma(x: str, n: int, w: WindowSpec) -> Column:
    return full(w, n, F.avg(x).over(last_rows(w, n)))


def rsi(x: str, n: int, w: WindowSpec) -> Column:
    """By simple sums of n changes; 100 without a loss. The frame is written over precomputed changes: see `with_change`."""
    f = last_rows(w, n)
    gain, loss = F.sum(F.greatest("change", F.lit(0.0))).over(f), F.sum(F.greatest(-F.col("change"), F.lit(0.0))).over(f)
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))
    return F.when(F.count("change").over(f) == n, value)


def with_change(bars: DataFrame, x: str, w: WindowSpec) -> DataFrame:
    return bars.withColumn("change", F.col(x) - F.lag(x).over(w))


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def stochastic(n: int, w: WindowSpec) -> Column:
    """%K; 50 on a flat range."""
    lo, hi = F.min("low").over(last_rows(w, n)), F.max("high").over(last_rows(w, n))
    return full(w, n, F.when(hi == lo, 50.0).otherwise(100 * (F.col("close") - lo) / (hi - lo)))


def cci(n: int, w: WindowSpec) -> Column:
    """Over the column `typical`; 0 on no deviation."""
    values = F.collect_list("typical").over(last_rows(w, n))
    mean = F.avg("typical").over(last_rows(w, n))
    deviation = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return full(w, n, F.when(deviation == 0, 0.0).otherwise((F.col("typical") - mean) / (0.015 * deviation)))


def persists(condition: Column, d: int, w: WindowSpec) -> Column:
    """True on all of the last d rows."""
    return F.coalesce(full(w, d, F.min(F.coalesce(condition, F.lit(False))).over(last_rows(w, d))), F.lit(False))


def channel_breakout(n: int, compress: float, x: float, w: WindowSpec) -> Column:
    """The n bars before lie within a narrow channel and the close breaks its high."""
    hi, lo = F.max("high").over(last_rows(w, n, 1)), F.min("low").over(last_rows(w, n, 1))
    return F.coalesce(full(w, n, (hi / lo - 1 <= compress) & (F.col("close") > hi * (1 + x)), 1), F.lit(False))


def above_prior_low(n: int, x: float, w: WindowSpec) -> Column:
    return F.coalesce(full(w, n, F.col("close") >= F.min("low").over(last_rows(w, n, 1)) * (1 + x), 1), F.lit(False))


def beyond_prior(n: int, w: WindowSpec) -> Column:
    """1 above the prior n bars' high, -1 below their low, else 0."""
    hi, lo = F.max("high").over(last_rows(w, n, 1)), F.min("low").over(last_rows(w, n, 1))
    return F.coalesce(full(w, n, F.when(F.col("close") > hi, 1).when(F.col("close") < lo, -1).otherwise(0), 1), F.lit(0))


def regime_by_rows(x: str, w: WindowSpec, a: int = 7, b: int = 14) -> Column:
    """bull if x >= x[-a] >= x[-b], bear if mirrored, else side."""
    p, q = F.lag(x, a).over(w), F.lag(x, b).over(w)
    return F.when(q.isNull(), None).when((F.col(x) >= p) & (p >= q), "bull").when((F.col(x) <= p) & (p <= q), "bear").otherwise("side")


def hysteresis(entry: Column, exit: Column, w: WindowSpec) -> Column:
    """Held from an entry until an exit, for rules that never say both on one row."""
    return F.coalesce(F.last(F.when(entry, 1).when(exit, 0), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def zscore_before(x: str, n: int, w: WindowSpec) -> Column:
    """Against the n rows before, population deviation; null on no deviation."""
    f = last_rows(w, n, 1)
    return full(w, n, F.when(F.stddev_pop(x).over(f) > 0, (F.col(x) - F.avg(x).over(f)) / F.stddev_pop(x).over(f)), 1)


def relative_to_median(x: str, n: int, w: WindowSpec) -> Column:
    return full(w, n, F.col(x) / F.percentile(x, 0.5).over(last_rows(w, n, 1)), 1)


def drawdown(x: str, w: WindowSpec) -> Column:
    return 1 - F.col(x) / F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def turnover(weights: DataFrame, key: str, time: str, weight: str) -> DataFrame:
    """Per time the sum of absolute weight changes over a dense grid; the first time counts in full."""
    w = Window.partitionBy(key).orderBy(time)
    return weights.withColumn("__d", F.abs(F.col(weight) - F.coalesce(F.lag(weight).over(w), F.lit(0.0)))).groupBy(time).agg(F.sum("__d").alias("turnover"))


def streaks(rows: DataFrame, key: str, bucket: str, order: list[str], win: Column) -> DataFrame:
    """Longest runs of wins and losses per key, by `bucket`, then `order`. Rows of a run have the same number of opposite rows before them."""
    counted = running_before(rows.select(key, bucket, *order, win.alias("won")), key, bucket, order, {"lost_before": (~F.col("won")).cast("int"), "won_before": F.col("won").cast("int")})
    runs = counted.groupBy(key, "won", F.when(F.col("won"), F.col("lost_before")).otherwise(F.col("won_before")).alias("island")).agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("won"), F.col("n"))), F.lit(0)).alias("win"), F.coalesce(F.max(F.when(~F.col("won"), F.col("n"))), F.lit(0)).alias("loss"))


def equal_parts(position: Column, n: Column, k: int) -> Column:
    """Part 0 to k - 1 of a 0-based position among n rows, by floor."""
    return F.floor(position * k / n)


def price_patterns(bars: DataFrame, key: str, time: str, n: int, gap: float, body: float) -> DataFrame:
    """`gap`: the low stands above the high two bars before by a share of the true range; `block`: a down bar before a strong up bar. With their middles."""
    w = Window.partitionBy(key).orderBy(time)
    tr, atr = free("pattern_range", bars), free("pattern_mean", bars)
    r = bars.withColumn(tr, true_range(w)).withColumn(atr, sma(tr, n, w))
    before = F.lag("high", 2).over(w)
    wide = F.coalesce(F.col("low") - before >= gap * F.col(atr), F.lit(False))
    strong = (F.lag("close").over(w) < F.lag("open").over(w)) & (F.col("close") > F.col("open")) & (F.col("close") - F.col("open") >= body * F.col(atr))
    block = F.coalesce(strong, F.lit(False))
    middle = (F.lag("high").over(w) + F.lag("low").over(w)) / 2
    return r.withColumns({"gap": wide, "gap_middle": F.when(wide, (F.col("low") + before) / 2), "block": block, "block_middle": F.when(block, middle)}).drop(tr, atr)
