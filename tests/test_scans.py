"""Recursive means and sliding aggregates against plain loops: nulls, ties, hot keys, clashing names, empty tables, growth."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import recursive, sliding

CLASH = ["k", "t", "b", "blk", "x0", "f0", "c0", "up", "down", "gain", "loss", "tr", "rise", "fall", "dx", "some", "mean", "fast", "slow", "at", "v0", "probe", "value_0", "s", "own", "n0", "wilder_up"]


def plain_means(values, alpha, n):
    out, seen, y = [], [], None
    for v in values:
        if v is None or math.isnan(v):
            out.append(None)
            continue
        seen.append(v)
        if len(seen) == n:
            y = sum(seen) / n
        elif len(seen) > n:
            y = alpha * v + (1 - alpha) * y
        out.append(y)
    return out


@pytest.mark.parametrize("bucket, reach", [(4096, 322.0), (7, 322.0), (50, 3.0), (3, 0.5)])
def test_smoothed_equals_a_loop(spark, monkeypatch, bucket, reach):
    monkeypatch.setattr(recursive, "REACH", reach if reach > 100 else 322.0)
    if reach < 100:  # short blocks and stretches: weights that are left out must be small, so values must forget quickly
        monkeypatch.setattr(recursive, "REACH", 45.0)
    dice = random.Random(bucket)
    rows = []
    for key in ("a", "b", None, "short"):
        for i in range(900 if key != "short" else 5):
            if dice.random() < 0.8:
                rows.append((key, i * 2 - 300, None if dice.random() < 0.2 else float("nan") if dice.random() < 0.02 else dice.uniform(-5, 5) * 10 ** dice.choice([0, 0, 3])))
    specs = [("quick", "close", 0.5, 3), ("wilder", F.col("close"), 1 / 14, 14), ("last", "close", 1.0, 1), ("long", "close", 2 / 201, 200)]
    df = spark.createDataFrame(rows, "symbol string, day long, close double").repartition(7)
    clash = df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))
    out = recursive.smoothed(clash, "symbol", "day", specs, bucket)
    assert out.columns == [*clash.columns, "quick", "wilder", "last", "long"]
    got = {(r.symbol, r.day): r for r in out.collect()}
    assert len(got) == len(rows) and all(r["x0"] == CLASH.index("x0") for r in got.values())
    for key in ("a", "b", None, "short"):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for name, _, alpha, n in specs:
            for r, want in zip(own, plain_means([r[2] for r in own], alpha, n)):
                have = got[key, r[1]][name]
                assert (have is None) == (want is None) and (want is None or abs(have - want) <= 1e-9 * max(1, abs(want))), (name, r, have, want)
    assert recursive.smoothed(df.limit(0), "symbol", "day", specs).count() == 0


def test_a_hot_key_spreads_over_tasks(spark):
    df = spark.range(300_000).select(F.lit("k").alias("symbol"), F.col("id").alias("day"), (F.col("id") % 97).cast("double").alias("close"))
    out = recursive.smoothed(df, "symbol", "day", [("y", "close", 0.1, 10)])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    y = None
    for i in range(300_000):
        y = sum(range(10)) / 10 if i == 9 else None if y is None else 0.9 * y + 0.1 * (i % 97)
    assert abs(out.where("day = 299999").first()["y"] - y) < 1e-9


@pytest.mark.parametrize("call", [recursive.rsi_wilder, recursive.adx, recursive.macd])
def test_indicators_leave_columns_alone(spark, call):
    dice = random.Random(3)
    rows = [(k, i, *(lambda c: (c - 1, c + dice.random() + 1, c - dice.random() - 1, c))(dice.uniform(50, 60))) for k in "ab" for i in range(80)]
    df = spark.createDataFrame(rows, "symbol string, day long, open double, high double, low double, close double")
    names = [c for c in CLASH if c not in ("close",)]
    plain, clash = call(df, "symbol", "day"), call(df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names))), "symbol", "day")
    added = [c for c in plain.columns if c not in df.columns]
    assert sorted(map(tuple, plain.select("symbol", "day", *added).collect())) == sorted(map(tuple, clash.select("symbol", "day", *added).collect()))
    assert set(names) <= set(clash.columns) and clash.select(names).distinct().count() == 1
    assert call(df.limit(0), "symbol", "day").count() == 0


@pytest.mark.parametrize("closed", ["left", "right"])
@pytest.mark.parametrize("length", [1, 4, 25])
def test_intervals_equal_a_loop(spark, closed, length):
    dice = random.Random(length)
    left = [(dice.choice(["a", "b", None]), dice.choice([None, *range(-40, 40)]), i) for i in range(150)]
    right = [(dice.choice(["a", "b", None]), dice.choice([None, *range(-40, 40)]), dice.choice([None, 1e18, 1.5, -2.0])) for i in range(300)]
    l = spark.createDataFrame(left, "key string, time long, id long").select("*", *(F.lit(1).alias(c) for c in CLASH))  # noqa: E741
    r = spark.createDataFrame(right, "key string, time long, value double")
    x = F.col("value")
    out = sliding.interval_aggregates(l, r, "key", "time", length, closed, {"total": ("sum", x), "n": ("count", x), "lowest": ("min", x), "highest": ("max", x)})
    got = {q.id: q for q in out.collect()}
    assert len(got) == len(left)
    for key, t, i in left:
        inside = [v for k, u, v in right if None not in (key, t, k, u, v) and k == key and (t - length < u <= t if closed == "right" else t - length <= u < t)]
        q = got[i]
        assert (q.n, q.lowest, q.highest) == (len(inside), min(inside, default=None), max(inside, default=None))
        assert (q.total is None) == (not inside) and (not inside or abs(q.total - math.fsum(inside)) <= 1e-9 * sum(map(abs, inside)))
    assert sliding.interval_aggregates(l, r.limit(0), "key", "time", length, closed, {"n": ("count", x)}).where("n = 0").count() == len(left)
    assert sliding.interval_aggregates(l.limit(0), r, "key", "time", length, closed, {"n": ("count", x)}).count() == 0


def test_a_small_sum_survives_a_large_one_before_it(spark):
    r = spark.createDataFrame([("a", 1, 1e18), ("a", 8, 0.25)], "k string, t long, x double")
    l = spark.createDataFrame([("a", 9)], "k string, t long")  # noqa: E741
    assert sliding.interval_aggregates(l, r, "k", "t", 5, "right", {"s": ("sum", F.col("x"))}).first()["s"] == 0.25


def test_interval_work_grows_with_the_rows(spark):
    def took(n):
        rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
        began = time.time()
        out = sliding.interval_aggregates(rows.select("k", "t"), rows, "k", "t", n // 2, "right", {"s": ("sum", F.col("x"))})
        assert out.agg(F.max("s")).first()[0] == n // 2
        return time.time() - began

    took(1000)
    assert took(400_000) <= 12 * max(1.0, took(40_000))


@pytest.mark.parametrize("block", [4096, 8])
def test_path_targets_equal_a_loop(spark, block):
    dice = random.Random(9)
    bars = {(k, s): (o := dice.uniform(9, 11), o + dice.random(), o - dice.random(), o + dice.uniform(-0.5, 0.5)) for k in "ab" for s in range(-20, 60) if dice.random() < 0.95}
    df = spark.createDataFrame([(k, s, *v) for (k, s), v in bars.items()], "key string, slot long, open double, high double, low double, close double").select("*", *(F.lit(1).alias(c) for c in CLASH))
    got = {(r.key, r.slot, r.horizon): r for r in sliding.path_targets(df, "key", "slot", [1, 2, 3, 5, 7], block).collect()}
    want = {(k, s, h) for k, s in bars for h in (1, 2, 3, 5, 7) if all((k, s + i) in bars for i in range(h))}
    assert set(got) == want
    for k, s, h in want:
        path = [bars[k, s + i] for i in range(h)]
        first, r = path[0][0], got[k, s, h]
        vol = math.sqrt(sum(math.log(p[3] / p[0]) ** 2 for p in path))
        for have, should in ((r.ret, path[-1][3] / first - 1), (r.best, max(p[1] for p in path) / first - 1), (r.worst, min(p[2] for p in path) / first - 1), (r.vol, vol)):
            assert abs(have - should) < 1e-12
    assert sliding.path_targets(df.limit(0), "key", "slot", [1, 3]).count() == 0
