"""First bar at which a level is touched, found by jumping.

Bars are summed up in blocks of `fan`, `fan`^2, ... slots: highest high, lowest low, largest fall from a high to a later low. A life of any length is a few dozen whole blocks; the first that holds a
touch is opened into its `fan` parts, down to a bar. So a trade costs a number of rows that grows with the logarithm of its life, and no row for each of its bars. Trades of one key with the same life and
the same levels are asked once, so that many trades over few bars cost no more than the lives that differ.

Cases: trades with a null id, key, start or end, or without a bar in their life, have no row; a null level is never touched; repeated trades (same id) count as one; slots are whole numbers, a slot that
repeats within its key counts as one bar with the highest high and lowest low; bars without a high or low only miss that side; an empty side gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.readers import written


def _blocks(bars: DataFrame, fan: int, levels: int) -> DataFrame:
    """k, level, block, hi, lo, fall of every block that has bars."""
    level = bars.groupBy("k", F.col("s").alias("block")).agg(F.max("high").alias("hi"), F.min("low").alias("lo")).withColumn("fall", F.lit(None).cast("double"))
    out = [level.withColumn("level", F.lit(0))]
    for i in range(1, levels + 1):
        up = F.floor(F.col("block") / fan)
        earlier = Window.partitionBy("k", "up").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        x = level.withColumn("up", up).withColumn("before", F.max("hi").over(earlier))
        level = x.groupBy("k", F.col("up").alias("block")).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max(F.greatest("fall", F.col("before") - F.col("lo"))).alias("fall"))
        out.append(level.withColumn("level", F.lit(i)))
    return reduce(DataFrame.unionByName, out)


def _cover(start: Column, end: Column, fan: int, levels: int) -> Column:
    """The blocks, as an array of (level, block), that make up the slots from start to end, both included."""

    def some(level: int, a: Column, b: Column) -> Column:
        none = F.expr("cast(array() as array<struct<level:int,block:bigint>>)")
        return F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))).otherwise(none)

    parts, a, b = [], start, end + 1
    for level in range(levels):
        up_a, up_b = F.ceil(a / fan), F.floor(b / fan)
        inner = up_a < up_b
        parts += [some(level, a, F.when(inner, up_a * fan).otherwise(b)), some(level, F.when(inner, up_b * fan).otherwise(b), b)]
        a, b = F.when(inner, up_a).otherwise(F.lit(0)), F.when(inner, up_b).otherwise(F.lit(0))
    return F.concat(*parts, some(levels, a, b))


def first_touch(
    trades: DataFrame, bars: DataFrame, trade: str, key: str, slot: str, start: str, end: str, floor: Column, ceiling: Column | None = None, peak: Column | None = None, trail: Column | None = None, fan: int = 16, levels: int = 3
) -> DataFrame:
    """trade, `slot` of its first bar from `start` to `end` (both included) whose low is at or below `floor` or whose high is at or above `ceiling`, `below` and `above` (which of them it was), `peak`.

    With `trail`, a low that is at least `trail` under the peak is below, too; the peak is the higher of `peak` and the highs of the life before the bar. A trade that is never touched has nulls behind its id.
    `levels`: blocks are of `fan` to `fan`^`levels` slots; more levels suit longer lives, and each costs a join. The result is the same.
    """
    none = F.lit(None).cast("double")
    level = lambda c, name: (none if c is None else c.cast("double")).alias(name)
    t = trades.select(
        F.col(trade).alias("id"), F.col(key).alias("k"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b"), level(floor, "floor"), level(ceiling, "ceiling"), level(peak, "peak"), level(trail, "trail")
    )
    t = written(t.where("id is not null and k is not null and a <= b"), "trades")
    asked_once = ["k", "a", "b", "floor", "ceiling", "peak", "trail"]
    lives = t.groupBy(*asked_once).agg(F.min("id").alias("id"))  # a life goes by the smallest id of its trades
    b = bars.where(F.col(key).isNotNull() & F.col(slot).isNotNull()).select(F.col(key).alias("k"), F.col(slot).cast("long").alias("s"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"))
    blocks = written(_blocks(b, fan, levels), "blocks")  # read once a level
    terms = ["floor", "ceiling", "trail"]
    low, fall = F.col("lo"), F.coalesce(F.col("fall") >= F.col("trail"), F.lit(False))
    below = F.coalesce(low <= F.col("floor"), F.lit(False)) | F.coalesce(F.col("peak") - low >= F.col("trail"), F.lit(False))
    above = F.coalesce(F.col("hi") >= F.col("ceiling"), F.lit(False))
    size = reduce(lambda c, i: F.when(F.col("level") == i, F.lit(fan**i)).otherwise(c), range(levels + 1), F.lit(None).cast("long"))

    def first(asked: DataFrame, how: str) -> DataFrame:
        """The first block of each id that holds a touch, with the peak before it."""
        x = asked.join(blocks, ["k", "level", "block"], how).withColumn("at", F.col("block") * size)
        before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("peak", F.greatest("peak", F.max("hi").over(before))).withColumn("below", below).withColumn("above", above)
        best = F.min_by(F.struct("k", "level", "block", "peak", "below", "above", *terms), F.when(F.col("below") | F.col("above") | fall, F.col("at")))
        return x.groupBy("id").agg(best.alias("f")).select("id", "f.*")

    cover = F.explode(_cover(F.col("a"), F.col("b"), fan, levels)).alias("c")
    found = first(lives.select("id", "k", "peak", *terms, cover).select("id", "k", "peak", *terms, "c.level", "c.block"), "inner")
    for i in range(levels, 0, -1):
        # What is found lower down, or not at all, stays as it is.
        block = F.col("block")
        parts = F.when(F.col("level") == i, F.sequence(block * fan, block * fan + fan - 1)).otherwise(F.array(block))
        found = first(found.select("id", "k", "peak", *terms, F.when(F.col("level") == i, i - 1).otherwise(F.col("level")).alias("level"), F.explode(parts).alias("block")), "left")
    answers = found.select("id", "block", "below", "above", F.col("peak").alias("highest")).join(lives, "id").select("block", "below", "above", "highest", *(F.col(c).alias(f"life_{c}") for c in asked_once))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"life_{c}")) for c in asked_once))
    return t.join(answers, same).dropDuplicates(["id"]).select(F.col("id").alias(trade), F.col("block").alias(slot), "below", "above", F.col("highest").alias("peak"))
