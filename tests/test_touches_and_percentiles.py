"""First touches by jumping, and percentiles by brackets, against plain loops and Spark's own buffer."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import percentiles, touches
from tidemark.plans import QUERIES


def touched(trade, bars):
    _, key, start, end, floor, ceiling, peak, trail = trade
    seen = False
    for s in range(start, end + 1) if None not in (key, start, end) else ():
        if (key, s) not in bars:
            continue
        seen = True
        high, low = bars[key, s]
        below = (floor is not None and low <= floor) or (trail is not None and peak is not None and peak - low >= trail)
        above = ceiling is not None and high >= ceiling
        if below or above:
            return (s, below, above, peak)
        peak = high if peak is None else max(peak, high)
    return (None, None, None, None) if seen else None


@pytest.mark.parametrize("fan, levels", [(2, 3), (4, 2), (16, 3)])
def test_first_touch_equals_a_walk(spark, fan, levels):
    dice = random.Random(fan)
    bars, price = {}, {"a": 100, "b": 100}
    for s in range(-300, 700):
        for k in "ab":
            price[k] += dice.choice([-1, 0, 1])
            if dice.random() < 0.9:
                bars[k, s] = (price[k] + dice.randrange(4) / 2, price[k] - dice.randrange(4) / 2)
    trades = []
    for i in range(700):
        start = dice.choice([None, *range(-320, 700)])
        end = None if start is None else start + dice.choice([-1, 0, 1, 5, 30, 200, 900])
        level = lambda x: dice.choice([None, 100.0 + x * dice.randrange(1, 25)])
        trades.append((i, dice.choice(["a", "b", "b", None]), start, end, level(-1), level(1), dice.choice([None, 100.0, 104.0]), dice.choice([None, None, 3.0, 9.0, 30.0])))
    t = spark.createDataFrame([*trades, trades[3]], "trade long, key string, start long, end long, floor double, ceiling double, peak double, trail double").withColumn("level", F.lit(1))
    b = spark.createDataFrame([(k, s, h, low) for (k, s), (h, low) in bars.items()], "key string, slot long, high double, low double").withColumn("id", F.lit(1))
    columns = [F.col(c) for c in ("floor", "ceiling", "peak", "trail")]
    found = touches.first_touch(t, b, "trade", "key", "slot", "start", "end", *columns, fan=fan, levels=levels)
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    want = {x[0]: touched(x, bars) for x in trades}
    assert got == {i: w for i, w in want.items() if w is not None}
    assert sum(w is not None and w[0] is not None for w in want.values()) > 100
    assert touches.first_touch(t.limit(0), b, "trade", "key", "slot", "start", "end", *columns).count() == 0
    assert touches.first_touch(t, b.limit(0), "trade", "key", "slot", "start", "end", *columns).count() == 0


def test_a_long_life_is_few_blocks(spark):
    lives = spark.createDataFrame([(1, 1), (5, 5 + 2190), (0, 1_000_000)], "a long, b long").select(F.size(touches._cover(F.col("a"), F.col("b"), 16, 3)).alias("n"), F.col("b") - F.col("a"))
    n = [r.n for r in lives.collect()]
    assert n[0] == 1 and n[1] <= 90 and n[2] <= 90 + 1_000_000 // 4096


@pytest.mark.parametrize("accuracy", [40, 1000, 10_000])
def test_percentiles_equal_the_buffer(spark, accuracy):
    dice = random.Random(accuracy)
    rows = [(dice.choice(["a", "a", "a", "b", None]), dice.choice([None, dice.gauss(0, 1), dice.gauss(0, 1), dice.gauss(0, 1), float(dice.randrange(3))])) for _ in range(30_000)]
    rows += [("few", 1.0), ("few", 2.0), ("none", None), ("one", -0.5)] + [("flat", 7.0)] * 500 + [("mixed", x) for x in [float("nan"), math.inf, -math.inf, 1.0] * 20]
    df = spark.createDataFrame(rows, "key string, v double").withColumn("n", F.lit(1)).withColumn("i", F.lit(1)).repartition(7)
    shares = {"p0": 0.0, "p5": 0.05, "third": 1 / 3, "half": 0.5, "p99": 0.99, "p100": 1.0}
    got = percentiles.exact_percentiles(df, ["key"], "v", shares, accuracy)
    want = df.groupBy("key").agg(F.count("v").alias("n"), *(F.percentile("v", q).alias(c) for c, q in shares.items()))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    whole = percentiles.exact_percentiles(df.where("key <> 'mixed'"), [], "v", shares, accuracy).collect()
    assert whole == df.where("key <> 'mixed'").agg(F.count("v").alias("n"), *(F.percentile("v", q).alias(c) for c, q in shares.items())).collect()
    assert percentiles.exact_percentiles(df.limit(0), ["key"], "v", shares, accuracy).count() == 0
    with pytest.raises(ValueError):
        percentiles.exact_percentiles(df, ["key"], "v", {"x": 1.5})


def test_tail_classifier_reads_bars_once(spark):
    """What is read again for labels, moments and the fit are the bars as written, not all line items."""
    from tests.conftest import DATA
    from tidemark.plans import QUERIES

    files = QUERIES["ml06_tail_classifier"](spark, f"{DATA}/sf0.001").inputFiles()
    assert files and not any("lineitem" in f for f in files)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trades_alike_are_asked_once(spark):
    """3,000 trades of two lives: blocks are met by the lives, and each trade has its own answer."""
    bars = spark.createDataFrame([("a", s, 10.0 + s, 9.0 + s) for s in range(40)], "key string, slot long, high double, low double")
    trades = spark.range(3000).select(F.col("id").alias("trade"), F.lit("a").alias("key"), (F.col("id") % 2).alias("start"), F.lit(35).alias("end"))
    found = touches.first_touch(trades, bars, "trade", "key", "slot", "start", "end", F.lit(None), F.lit(20.0), levels=1)
    assert re.search(r"Aggregate \[k#\d+, a#\d+L, b#\d+L, floor#\d+, ceiling#\d+", plan_of(found))
    assert sorted(map(tuple, found.select("trade", "slot", "below", "above").collect())) == [(i, 10, False, True) for i in range(3000)]


@pytest.mark.parametrize("name", ["wn28_first_touch", "wn29_trailing_exit", "wn36_decision_features"])
def test_bars_are_made_once(spark, name):
    """Line items are read for the bars only, which are written; no order is sorted among its days."""
    plan = plan_of(QUERIES[name](spark, f"{DATA}/sf0.001"))
    assert "l_partkey" not in plan and "windowspecdefinition(o_orderkey" not in plan
