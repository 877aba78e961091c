"""Indicators that carry a state from bar to bar, as an associative scan.

y = a * y + b is a pair (a, b), and pairs compose, so a series need not be walked in one task. Bars meet in buckets of time, cut into blocks of rows short enough that the powers of a stay within
doubles; in a block a running sum of b / a ** i, times a ** i, is the state from zero. Each block leaves one row (its number of values and its end state), these are scanned in the same way, and each
bar adds the state that its block starts from, times its power of a. Values that lie so far back that their weight is below 1e-140 are not added.

Cases: null and not-a-number values are skipped and their rows get null; rows before the seed get null; rows with a null key are a series of their own; an empty table gives an empty one;
bars of a key tied on time have no defined order; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import free

#: Width of a bucket in units of the order column, and the log of the smallest power of a in a block.
BUCKET, REACH = 4096, 322.0

Spec = tuple[str, "str | Column", float, int]


def smoothed(bars: DataFrame, key: str, order: str, specs: list[Spec], bucket: int = BUCKET) -> DataFrame:
    """Adds exponential means. Each of `specs` is (name, expression on columns of `bars`, alpha, n).

    Seeded with the mean of the first n values that aren't null, null before it; null values are skipped.
    """
    keep = [max(1 - alpha, 1e-18) for _, _, alpha, _ in specs]
    reach = [max(1, math.floor(REACH / -math.log(a))) for a in keep]
    rows_of = min(65_536, *reach)
    every = range(len(specs))
    names = [f"c{i}" for i in range(len(bars.columns))]
    place = dict(zip(bars.columns, names, strict=True))
    value = [F.nanvl((F.expr(e) if isinstance(e, str) else e).cast("double"), F.lit(None).cast("double")) for _, e, _, _ in specs]
    x = bars.select("*", *(v.alias(free(f"value_{i}", bars)) for i, v in enumerate(value))).toDF(*names, *(f"x{i}" for i in every))
    k, t = place[key], place[order]
    x = x.withColumn("b", F.floor(F.col(t) / bucket))
    x = x.withColumn("blk", F.expr(f"(row_number() over (partition by {k}, b order by {t}) - 1) div {rows_of}"))
    w = Window.partitionBy(k, "b", "blk").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"n{i}": F.count(f"x{i}").over(w) for i in every})
    power = lambda i, e: F.pow(F.lit(keep[i]), e.cast("double"))
    x = x.withColumns({f"f{i}": power(i, F.col(f"n{i}")) * F.sum((1 - keep[i]) * F.col(f"x{i}") / power(i, F.col(f"n{i}"))).over(w) for i in every})
    first = [F.sort_array(F.collect_list(F.when(F.col(f"x{i}").isNotNull() & (F.col(f"n{i}") <= specs[i][3]), F.struct(f"n{i}", f"x{i}")))).alias(f"first{i}") for i in every]
    blocks = x.groupBy(k, "b", "blk").agg(*(F.max(f"n{i}").alias(f"m{i}") for i in every), *(F.coalesce(F.max_by(f"f{i}", F.when(F.col(f"x{i}").isNotNull(), F.col(f"n{i}"))), F.lit(0.0)).alias(f"s{i}") for i in every), *first)
    carried = _carried(blocks, k, [(keep[i], reach[i], specs[i][3]) for i in every])
    joined = x.join(carried, F.col(k).eqNullSafe(F.col("bk")) & F.col("b").eqNullSafe(F.col("bb")) & (F.col("blk") == F.col("bblk")))
    out = {}
    for i, (name, *_, n) in enumerate(specs):
        at = F.col(f"before{i}") + F.col(f"n{i}")
        y = F.col(f"f{i}") + power(i, F.col(f"n{i}")) * F.col(f"carry{i}") + power(i, at - n) * F.col(f"seed{i}")
        out[name] = F.when(F.col(f"x{i}").isNotNull() & (at >= n), y)
    return joined.select(*(F.col(at).alias(c) for c, at in place.items() if c not in out), *(y.alias(name) for name, y in out.items()))


def _carried(blocks: DataFrame, k: str, rules: list[tuple[float, int, int]]) -> DataFrame:
    """For each block: values of its key before it, the state that it starts from, and what the seed adds to the state at the n-th value."""
    over = Window.partitionBy(k).orderBy("b", "blk")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    every = range(len(rules))
    power = lambda i, e: F.pow(F.lit(rules[i][0]), e.cast("double"))
    within = lambda i: Window.partitionBy(k, f"stretch{i}").orderBy("b", "blk").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    # Ends of blocks that lie within one stretch of `reach` values are added up; of earlier ones only the last end can matter.
    x = blocks.withColumns({f"before{i}": F.coalesce(F.sum(f"m{i}").over(before), F.lit(0)) for i in every})
    x = x.withColumns({f"end{i}": c(f"before{i}") + c(f"m{i}") for i in every}).withColumns({f"stretch{i}": F.expr(f"end{i} div {rules[i][1]}") for i in every})
    into = {i: power(i, c(f"end{i}") - c(f"stretch{i}") * rules[i][1]) for i in every}
    x = x.withColumns({f"local{i}": into[i] * F.sum(c(f"s{i}") / into[i]).over(within(i)) for i in every})
    edge = {i: F.when(F.lag(f"stretch{i}").over(over) < c(f"stretch{i}"), F.struct(F.lag(f"end{i}").over(over).alias("at"), F.lag(f"local{i}").over(over).alias("y"))) for i in every}
    x = x.withColumns({f"edge{i}": edge[i] for i in every})
    x = x.withColumns({f"one{i}": F.last(f"edge{i}", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)) for i in every})
    x = x.withColumns({f"state{i}": c(f"local{i}") + F.coalesce(power(i, c(f"end{i}") - c(f"one{i}.at")) * c(f"one{i}.y"), F.lit(0.0)) for i in every})
    x = x.withColumns({f"carry{i}": F.coalesce(F.lag(f"state{i}").over(over), F.lit(0.0)) for i in every})
    seeds, whole = {}, Window.partitionBy(k)
    for i, (a, _, n) in enumerate(rules):
        # The first values of the key, from the blocks that have some of them; the state from zero after them is taken out and their mean put in.
        some = F.when((F.col(f"before{i}") < n) & (F.col(f"m{i}") > 0), F.struct(f"before{i}", _field(f"first{i}", f"x{i}").alias("v")))
        seeds[f"values{i}"] = F.slice(F.flatten(_field(F.sort_array(F.collect_list(some).over(whole)), "v")), 1, n)
    x = x.withColumns(seeds)
    seed = {}
    for i, (a, _, n) in enumerate(rules):
        values = F.col(f"values{i}")
        seed[f"seed{i}"] = F.when(F.size(values) == n, _folded(values, 1.0, 1.0) / n - _folded(values, a, 1 - a))
    kept = [c for i in range(len(rules)) for c in (f"before{i}", f"carry{i}")]
    return x.withColumns(seed).select(F.col(k).alias("bk"), F.col("b").alias("bb"), F.col("blk").alias("bblk"), *kept, *seed)


def _field(structs: Column | str, name: str) -> Column:
    return F.transform(structs, lambda s: s[name])


def _folded(values: Column, keep: float, weight: float) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda y, v: keep * y + weight * v)


def ema_spec(name: str, expression: str | Column, n: int) -> Spec:
    return name, expression, 2 / (n + 1), n


@dataclass(frozen=True)
class Part:
    """An indicator that shares its scan with others: what it adds before, what it smooths, and what it makes of it."""

    prepare: Callable[[DataFrame], DataFrame]
    specs: list[Spec]
    finish: Callable[[DataFrame], DataFrame]


def together(bars: DataFrame, key: str, order: str, parts: list[Part], bucket: int = BUCKET) -> DataFrame:
    """All parts from one scan."""
    x = bars
    for part in parts:
        x = part.prepare(x)
    x = smoothed(x, key, order, [s for part in parts for s in part.specs], bucket)
    for part in parts:
        x = part.finish(x)
    return x


def means_part(specs: list[Spec]) -> Part:
    return Part(lambda x: x, specs, lambda x: x)


def rsi_part(bars: DataFrame, key: str, order: str, n: int = 14, x: str = "close") -> Part:
    gain, loss, up, down = (free(f"wilder_{c}", bars) for c in ("gain", "loss", "up", "down"))
    change = F.col(x) - F.lag(x).over(Window.partitionBy(key).orderBy(order))
    return Part(
        lambda b: b.withColumns({gain: F.greatest(change, change * 0), loss: F.greatest(-change, change * 0)}),
        [(up, F.col(gain), 1 / n, n), (down, F.col(loss), 1 / n, n)],
        lambda s: s.withColumn("rsi", F.when(F.col(down) == 0, 100.0).otherwise(100 - 100 / (1 + F.col(up) / F.col(down)))).drop(gain, loss, up, down),
    )


def adx_part(bars: DataFrame, key: str, order: str, n: int = 14) -> Part:
    tr, rise, fall, str_, srise, sfall, dx, some, mean = (free(f"adx_{c}", bars) for c in ("tr", "rise", "fall", "str", "srise", "sfall", "dx", "some", "mean"))
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag("close").over(w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    moves = {
        tr: F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))),
        rise: F.when((up > down) & (up > 0), up).when(before.isNotNull(), 0.0),
        fall: F.when((down > up) & (down > 0), down).when(before.isNotNull(), 0.0),
    }

    def finish(s: DataFrame) -> DataFrame:
        both = F.col(srise) + F.col(sfall)
        index = F.when((F.lag(str_).over(w).isNotNull()) & (F.col(str_) != 0) & (both != 0), 100 * F.abs(F.col(srise) - F.col(sfall)) / both)
        s = s.withColumn(dx, index).withColumn(some, F.col(dx).isNotNull())
        last = Window.partitionBy(key, some).orderBy(order).rowsBetween(-(n - 1), 0)
        s = s.withColumn(mean, F.when(F.col(some) & (F.count(dx).over(last) == n), F.avg(dx).over(last)))
        carried = F.last(mean, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return s.withColumn("adx", carried).drop(tr, rise, fall, str_, srise, sfall, dx, some, mean)

    return Part(lambda b: b.withColumns(moves), [(str_, F.col(tr), 1 / n, n), (srise, F.col(rise), 1 / n, n), (sfall, F.col(fall), 1 / n, n)], finish)


def macd_part(bars: DataFrame, key: str, order: str, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close", bucket: int = BUCKET) -> Part:
    quick, lazy = free("macd_fast", bars), free("macd_slow", bars)

    def finish(s: DataFrame) -> DataFrame:
        s = s.withColumn("macd", F.col(quick) - F.col(lazy)).drop(quick, lazy)
        s = smoothed(s, key, order, [ema_spec("signal", F.col("macd"), signal)], bucket)
        return s.withColumn("histogram", F.col("macd") - F.col("signal"))

    return Part(lambda b: b, [ema_spec(quick, F.col(x), fast), ema_spec(lazy, F.col(x), slow)], finish)


def rsi_wilder(bars: DataFrame, key: str, order: str, n: int = 14, x: str = "close", bucket: int = BUCKET) -> DataFrame:
    """`rsi` from Wilder's means of gains and losses; 100 without a loss."""
    return together(bars, key, order, [rsi_part(bars, key, order, n, x)], bucket)


def adx(bars: DataFrame, key: str, order: str, n: int = 14, bucket: int = BUCKET) -> DataFrame:
    """`adx`: mean of the last n directional indexes, from the bar after the seed on; bars without an index repeat the mean."""
    return together(bars, key, order, [adx_part(bars, key, order, n)], bucket)


def macd(bars: DataFrame, key: str, order: str, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close", bucket: int = BUCKET) -> DataFrame:
    """`macd`, its `signal` line and the `histogram`."""
    return together(bars, key, order, [macd_part(bars, key, order, fast, slow, signal, x, bucket)], bucket)
