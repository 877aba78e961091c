"""Aggregates over sliding intervals in linear time, whatever the length of the interval.

Trailing intervals: time is cut into buckets as wide as the interval, so an interval is the end of one bucket and the start of the next. Each bucket is scanned forward and backward once, and an answer
combines one value of each scan. Nothing is subtracted, so sums lose nothing to cancellation, and the same way serves minima and maxima.
Horizons: values over 1, 2, 4, ... bars ahead, each from the one before, give every horizon as two that overlap (extremes) or as some that adjoin (sums).

Buckets and blocks meet in one task, keys do not. Cases: rows with a null key or time take no part on the right and find nothing on the left; repeated left rows each get the answer; right rows tied
on time all count; null values count for nothing; an empty side finds nothing; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import free

#: How values of a kind combine; counts add up.
COMBINE: dict[str, Callable] = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
FIRST: dict[str, Callable] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def interval_aggregates(left: DataFrame, right: DataFrame, key: str, time: str, length: int, closed: str, aggregates: dict[str, tuple[str, Column]]) -> DataFrame:
    """`left` with, for each name of `aggregates`, its (kind, column of `right`) over the rows of the key in a trailing interval; kind: sum, count, min or max.

    `closed`: "right" for (t - length, t], "left" for [t - length, t). Nothing in the interval: count 0, else null.
    """
    if closed not in ("left", "right"):
        raise ValueError("closed is left or right")
    k, t = F.col(key).alias("k"), F.col(time).cast("long").alias("t")
    names = {out: f"v{i}" for i, out in enumerate(aggregates)}
    kinds = {names[out]: kind for out, (kind, _) in aggregates.items()}
    r = right.select(k, t, *(e.alias(names[out]) for out, (_, e) in aggregates.items())).where("k is not null and t is not null")
    r = r.groupBy("k", "t").agg(*(FIRST[kind](v).alias(v) for v, kind in kinds.items())).withColumn("probe", F.lit(0))
    asked = left.select(k, t.alias("at")).where("k is not null and at is not null").distinct()
    probes = asked.select("k", "at", F.explode(F.array(F.struct(F.col("at").alias("t"), F.lit(1).alias("probe")), F.struct((F.col("at") - length).alias("t"), F.lit(2).alias("probe")))).alias("p"))
    rows = r.unionByName(probes.select("k", "at", "p.t", "p.probe"), allowMissingColumns=True).withColumn("b", F.floor(F.col("t") / length)).withColumn("asks", F.col("probe") > 0)
    # Up to its own time a probe sees rows tied with it if the interval is closed on the right; from its start on if it is closed on the left.
    last = closed == "right"
    ahead = Window.partitionBy("k", "b").orderBy("t", F.asc("asks") if last else F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("k", "b").orderBy(F.desc("t"), F.desc("asks") if last else F.asc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumns({f"to_{v}": COMBINE[kind](v).over(ahead) for v, kind in kinds.items()}).withColumns({f"from_{v}": COMBINE[kind](v).over(back) for v, kind in kinds.items()})
    found = scanned.where("asks").groupBy("k", "at").agg(*(COMBINE[kind](F.when(F.col("probe") == 1, F.col(f"to_{v}")).otherwise(F.col(f"from_{v}"))).alias(v) for v, kind in kinds.items()))
    own = [free(f"sliding_{c}", left) for c in ("k", "at", *kinds)]
    joined = left.join(found.toDF(*own), (F.col(key) == F.col(own[0])) & (F.col(time) == F.col(own[1])), "left")
    value = {out: F.coalesce(F.col(free(f"sliding_{v}", left)), F.lit(0)) if kinds[v] == "count" else F.col(free(f"sliding_{v}", left)) for out, v in names.items()}
    return joined.select(*(F.col(f"`{c}`") for c in left.columns), *(e.alias(out) for out, e in value.items()))


def path_targets(bars: DataFrame, key: str, slot: str, horizons: list[int], block: int = 4096) -> DataFrame:
    """For each bar as entry at its open and each of `horizons` (numbers of bars): return, best and worst excursion, and volatility over them, only where all of the bars exist.

    A block of slots meets in one task, with the bars after it that its own ones see. `slot` is a whole number without repeats in a key.
    """
    longest = max(horizons)
    step = F.log(F.col("close") / F.col("open"))
    x = bars.where(F.col(key).isNotNull() & F.col(slot).isNotNull()).select(
        F.col(key).alias("k"), F.col(slot).cast("long").alias("s"), "open", "close", F.col("high").alias("high_0"), F.col("low").alias("low_0"), (step * step).alias("square_0")
    )
    b = F.floor(F.col("s") / block)
    late = F.col("s") - b * block < longest - 1
    x = x.withColumn("b", F.explode(F.when(late, F.array(b, b - 1)).otherwise(F.array(b)))).withColumn("own", F.col("b") == b)
    w = Window.partitionBy("k", "b").orderBy("s")
    for level in range(1, longest.bit_length()):
        ahead = lambda c, n=1 << level - 1, k=level - 1: F.lead(f"{c}_{k}", n).over(w)
        below = lambda c, k=level - 1: F.col(f"{c}_{k}")
        x = x.withColumns({f"high_{level}": F.greatest(below("high"), ahead("high")), f"low_{level}": F.least(below("low"), ahead("low")), f"square_{level}": below("square") + F.coalesce(ahead("square"), F.lit(0.0))})
    targets = {}
    for h in horizons:
        level, at, squares = h.bit_length() - 1, 0, []
        for i in reversed(range(h.bit_length())):
            if h >> i & 1:
                squares.append(F.lead(f"square_{i}", at).over(w))
                at += 1 << i
        rest = h - (1 << level)
        targets[f"target_{h}"] = F.struct(
            F.lit(h).alias("horizon"), (F.lead("s", h - 1).over(w) == F.col("s") + h - 1).alias("whole"), F.lead("close", h - 1).over(w).alias("last"), F.greatest(f"high_{level}", F.lead(f"high_{level}", rest).over(w)).alias("high"),
            F.least(f"low_{level}", F.lead(f"low_{level}", rest).over(w)).alias("low"), F.sqrt(sum(squares[1:], squares[0])).alias("vol"),
        )
    found = x.withColumns(targets).where("own").select("k", "s", "open", F.explode(F.array(*targets)).alias("t")).where("t.whole")
    return found.select(
        F.col("k").alias(key), F.col("s").alias(slot), "t.horizon", (F.col("t.last") / F.col("open") - 1).alias("ret"), (F.col("t.high") / F.col("open") - 1).alias("best"), (F.col("t.low") / F.col("open") - 1).alias("worst"), "t.vol"
    )
