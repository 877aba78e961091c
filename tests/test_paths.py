"""Paths from summaries against plain loops, and bootstraps of nothing."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import paths, stats, trials


@pytest.mark.parametrize("n, block", [(1, 1), (5, 14), (30, 7), (28, 7), (40, 1)])
def test_path_bootstrap_equals_a_loop(spark, n, block):
    dice = random.Random(n)
    x = [dice.uniform(-0.2, 0.22) for _ in range(n)]
    k = -(-n // block)
    picks = {(d, j): dice.randrange(n) for d in range(6) for j in range(k)}
    df = spark.createDataFrame([(i * 3, v) for i, v in enumerate(x)], "day long, r double").withColumn("start", F.lit("clash"))
    starts = lambda d, k, n: spark.createDataFrame([(d, j, p) for (d, j), p in picks.items()], "draw long, j int, pick int")
    got = {r.draw: r for r in paths.path_bootstrap(df, "day", "r", block, 6, starts).collect()}
    for d in range(6):
        path = [x[(picks[d, j] + o) % n] for j in range(k) for o in range(block)][:n]
        value = peak = 1.0
        fall = 0.0
        for v in path:
            value *= 1 + v
            peak = max(peak, value)
            fall = max(fall, 1 - value / peak)
        assert abs(got[d].total - (value - 1)) < 1e-9 and abs(got[d].drawdown - fall) < 1e-9 and abs(got[d]["mean"] - sum(path) / n) < 1e-9


@pytest.mark.parametrize("block", [1, 14])
def test_growth_of_a_path_whose_total_is_too_large_for_a_double(spark, block):
    """2,000 days of +60 % or -10 %: totals are beyond 1e308, their logs are not."""
    x = [0.6 if i % 11 else -0.1 for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(x)), "day long, r double")
    k = -(-2000 // block)
    got = {r.draw: r for r in trials.path_bootstrap(df, "day", "r", block, 3, 5).collect()}
    for d in range(3):
        path = [x[(((d * k + j) * 1103515245 + 5) % 2147483648 % 2000 + o) % 2000] for j in range(k) for o in range(block)][:2000]
        assert got[d].total == math.inf and abs(got[d].growth - sum(map(math.log1p, path))) < 1e-6


@pytest.mark.parametrize("block", [4096, 8])
def test_trade_draws_equal_a_loop(spark, block):
    dice = random.Random(block)
    rows = [(dice.randrange(-50, 300), dice.choice([None, *(float(v) for v in range(-30, 31, 7))])) for _ in range(120)] + [(7, 1.0)] * 3
    got = {r.draw: r for r in paths.trade_draws(spark.createDataFrame(rows, "k long, v double"), "k", "v", 5, 3, 500.0, block).collect()}
    x = [v for _, v in sorted((k, v or 0.0) for k, v in rows)]
    n = len(x)
    for d in range(5):
        path = [x[int(hashlib.md5(f"3:{d * n + j}".encode()).hexdigest()[:12], 16) % n] for j in range(n)]
        value = peak = 500.0
        fall = 0.0
        for v in path:
            value += v
            peak = max(peak, value)
            fall = max(fall, (peak - value) / peak)
        wins, losses = sum(v for v in path if v > 0), -sum(v for v in path if v < 0)
        r = got[d]
        assert abs(r.drawdown - fall) < 1e-9 and abs(r["mean"] - sum(path) / n) < 1e-9 and abs(r.profit_factor - wins / losses) < 1e-9


@pytest.mark.parametrize("length, draws", [(7, 4), (64, 3), (1000, 5000)])
def test_trade_draws_of_many_parts(spark, length, draws):
    """Parts of a few picks, and two buckets of trades: falls within a part, over parts and below the peak of a part before."""
    dice = random.Random(length)
    x = [dice.choice([-40.0, 35.0]) * dice.random() for _ in range(500)]
    n = len(x)
    df = spark.createDataFrame(list(enumerate(x)), "k long, v double")
    found = paths.trade_draws(df, "k", "v", draws, 9, 100.0, 16, length)
    got = {r.draw: r for r in found.where("draw < 4").collect()}
    assert len(got) == min(draws, 4)
    for d, r in got.items():
        value = peak = 100.0
        fall = 0.0
        for j in range(n):
            value += x[int(hashlib.md5(f"9:{d * n + j}".encode()).hexdigest()[:12], 16) % n]
            peak = max(peak, value)
            fall = max(fall, (peak - value) / peak)
        assert abs(r.drawdown - fall) < 1e-9


def test_trade_draws_shuffle_arrays_and_no_picks(spark):
    """A pick is no row of the plan: what is shuffled between drawing and looking up is a row for each part and bucket."""
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7 - 3.0).alias("v"))
    plan = paths.trade_draws(df, "k", "v", 10, 1, 100.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "Range (0, 10," in plan


def test_bootstraps_of_nothing(spark):
    empty = spark.createDataFrame([], "k long, v double, c long")
    for found in (
        stats.block_bootstrap(empty, "k", "v", 5, 10, 1), trials.cluster_bootstrap(empty, ["k"], "v", "c", 10, 1), trials.path_bootstrap(empty, "k", "v", 5, 10, 1), paths.trade_draws(empty, "k", "v", 10, 1, 100.0),
        trials.fold_block_bootstrap(empty, "c", "k", "v", 5, 10, 1, True),
    ):
        assert found.count() == 0
