"""A later row that changes must not move what an earlier row says."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import indicators as I
from tidemark.operators import order_statistics, recursive, regimes, selection

CUT = 80


def bars(spark, changed: bool):
    dice = random.Random(1)
    rows = []
    for key in ("a", "b"):
        close = 100.0
        for day in range(120):
            opening, close = close, close * (1 + dice.uniform(-0.05, 0.05))
            high, low = max(opening, close) * 1.01, min(opening, close) * 0.99
            scale = 3.0 if changed and day > CUT else 1.0
            rows.append((key, day, opening * scale, high * scale, low * scale, close * scale, dice.uniform(1, 9) * scale, close * scale))
    return spark.createDataFrame(rows, "symbol string, day long, open double, high double, low double, close double, volume double, turnover double")


def w():
    return Window.partitionBy("symbol").orderBy("day")


RULES = {
    "sma": lambda b: b.withColumn("x", I.sma("close", 10, w())),
    "rsi": lambda b: I.with_change(b, "close", w()).withColumn("x", I.rsi("close", 14, w())),
    "range": lambda b: b.withColumn("x", I.true_range(w())),
    "stochastic": lambda b: b.withColumn("x", I.stochastic(14, w())),
    "channel": lambda b: b.withColumn("x", I.channel_breakout(10, 0.3, 0.001, w())),
    "beyond": lambda b: b.withColumn("x", I.beyond_prior(10, w())),
    "zscore": lambda b: b.withColumn("x", I.zscore_before("volume", 30, w())),
    "median": lambda b: b.withColumn("x", I.relative_to_median("volume", 30, w())),
    "regime": lambda b: b.withColumn("x", I.regime_by_rows("close", w())),
    "drawdown": lambda b: b.withColumn("x", I.drawdown("close", w())),
    "percentile": lambda b: order_statistics.trailing_percentile(b, "symbol", "day", "close", 60, 20, "x"),
    "patterns": lambda b: I.price_patterns(b, "symbol", "day", 14, 0.15, 1.0).withColumn("x", F.concat_ws("|", "gap", "gap_middle", "block", "block_middle")),
    "wilder": lambda b: recursive.rsi_wilder(b, "symbol", "day").withColumn("x", F.col("rsi")),
    "adx": lambda b: recursive.adx(b, "symbol", "day").withColumn("x", F.col("adx")),
    "macd": lambda b: recursive.macd(b, "symbol", "day").withColumn("x", F.col("histogram")),
    "snapshot": lambda b: regimes.snapshots(regimes.measured(b, "symbol", "day")).withColumn("x", F.concat_ws("|", "regime", "side", "adx", "rsi")),
    "universe": lambda b: selection.liquid_universe(b, 1, 30).withColumn("x", F.col("rank")),
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_no_look_ahead(spark, name):
    said = [{(r.symbol, r.day): r.x for r in RULES[name](bars(spark, changed)).select("symbol", "day", "x").collect()} for changed in (False, True)]
    before = [{k: v for k, v in s.items() if k[1] <= CUT} for s in said]
    assert before[0] == before[1] and any(v is not None for v in before[0].values())
    assert name in ("channel", "regime", "universe", "snapshot") or said[0] != said[1]


def test_directions_see_only_closed_days(spark):
    def rules(changed):
        b = bars(spark, changed)
        daily = regimes.snapshots(regimes.measured(b, "symbol", "day", regimes.Lengths(5, 3, 6, 3, 6, 3)), regimes.Limits(0.5, 20, 15, 0.001))
        slots = bars(spark, False).withColumn("slot", F.col("day") + 0)
        intraday = regimes.snapshots(regimes.measured(slots, "symbol", "slot", regimes.Lengths(5, 3, 6, 3, 6, 3)), regimes.Limits(0.5, 20, 15, 0.001))
        # a bar of day d closes when that day does, less a second: it may only know day d - 1
        x = regimes.directions(intraday, daily, "symbol", (F.col("slot") + 1) * 86_400 - 1, (F.col("day") + 1) * 86_400, F.lit(True), lookback=6)
        return {(r.symbol, r.slot): (r.confluence, r.breakout, r.momentum, r.pullback) for r in x.collect()}

    one, two = rules(False), rules(True)
    assert all(one[k] == two[k] for k in one if k[1] <= CUT + 1)
    assert any(any(v) for v in one.values()) and one != two
