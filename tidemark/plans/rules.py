"""Queries over recursive indicators, trading rules, overlays and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import indicators as I
from tidemark.operators import order_statistics, recursive, selection, walkforward
from tidemark.plans.demo import BARS_1D, BARS_4H, TRADES, bars_1d, bars_4h, trades
from tidemark.plans.market import OVER, W, rows
from tidemark.plans.registry import query, rounded


def smoothing(name: str, source: str, time: str, columns: list[str], alpha: str, n: int) -> str:
    """CTEs for exponential means of columns of `source` seeded with the mean of n rows; for WITH RECURSIVE."""
    seed = ", ".join(f"avg({c}) OVER (PARTITION BY symbol ORDER BY {time} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS s_{c}" for c in columns)
    step = ", ".join(f"q.{c} * {alpha} + e.{c} * (1 - {alpha})" for c in columns)
    return f"""{name}_q AS (SELECT symbol, {time}, {", ".join(columns)}, row_number() OVER (PARTITION BY symbol ORDER BY {time}) AS i, {seed} FROM {source} WHERE {columns[0]} IS NOT NULL),
{name} AS (SELECT symbol, {time}, i, {", ".join(f"s_{c} AS {c}" for c in columns)} FROM {name}_q WHERE i = {n} UNION ALL SELECT q.symbol, q.{time}, q.i, {step} FROM {name} e JOIN {name}_q q ON q.symbol = e.symbol AND q.i = e.i + 1)"""


@query(f"""WITH RECURSIVE {BARS_4H}, {smoothing("e", "b4", "slot", ["close"], "(2.0::DOUBLE / 11)", 10)}
SELECT b4.symbol, b4.slot, round(e.close, 6) AS ema FROM b4 LEFT JOIN e USING (symbol, slot)""")
def wn02_ema(spark, d):
    return rounded(recursive.smoothed(bars_4h(spark, d), "symbol", "slot", [recursive.ema_spec("ema", "close", 10)]).select("symbol", "slot", "ema"), "ema")


@query(f"""WITH RECURSIVE {BARS_1D}, c AS (SELECT symbol, day, greatest(x, 0) AS g, greatest(-x, 0) AS l FROM (SELECT symbol, day, close - lag(close) {OVER}) AS x FROM b) WHERE x IS NOT NULL),
{smoothing("e", "c", "day", ["g", "l"], "(1.0::DOUBLE / 14)", 14)}
SELECT b.symbol, b.day, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM b LEFT JOIN e USING (symbol, day)""")
def wn04_rsi_wilder(spark, d):
    return rounded(recursive.rsi_wilder(bars_1d(spark, d), "symbol", "day").select("symbol", "day", "rsi"), "rsi")


@query(f"""WITH RECURSIVE {BARS_1D}, p AS (SELECT *, lag(close) {OVER}) AS pc, high - lag(high) {OVER}) AS up, lag(low) {OVER}) - low AS dn FROM b),
m AS (SELECT symbol, day, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS r, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS f FROM p WHERE pc IS NOT NULL),
{smoothing("e", "m", "day", ["tr", "r", "f"], "(1.0::DOUBLE / 14)", 14)},
x AS (SELECT symbol, day, 100 * abs(r - f) / (r + f) AS dx FROM e WHERE i > 14 AND tr <> 0 AND r + f <> 0),
y AS (SELECT symbol, day, CASE WHEN count(*) {rows(14)} = 14 THEN avg(dx) {rows(14)} END AS adx FROM x)
SELECT b.symbol, b.day, round(last_value(adx IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.day ROWS UNBOUNDED PRECEDING), 6) AS adx FROM b LEFT JOIN y USING (symbol, day)""")
def wn06_adx(spark, d):
    return rounded(recursive.adx(bars_1d(spark, d), "symbol", "day").select("symbol", "day", "adx"), "adx")


@query(f"""WITH RECURSIVE {BARS_1D}, {smoothing("f", "b", "day", ["close"], "(2.0::DOUBLE / 13)", 12)}, {smoothing("s", "b", "day", ["close"], "(2.0::DOUBLE / 27)", 26)},
m AS (SELECT symbol, s.day, f.close - s.close AS macd FROM f JOIN s USING (symbol, i)), {smoothing("g", "m", "day", ["macd"], "0.2::DOUBLE", 9)}
SELECT b.symbol, b.day, round(m.macd, 6) AS macd, round(g.macd, 6) AS signal, round(m.macd - g.macd, 6) AS histogram FROM b LEFT JOIN m USING (symbol, day) LEFT JOIN g USING (symbol, day)""")
def wn07_macd(spark, d):
    return rounded(recursive.macd(bars_1d(spark, d), "symbol", "day").select("symbol", "day", "macd", "signal", "histogram"), "macd", "signal", "histogram")


@query(f"""WITH {BARS_1D}, g AS (SELECT symbol, day, close, list(close) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING) AS l FROM b)
SELECT symbol, day, CASE WHEN len(l) >= 180 THEN round((len(list_filter(l, lambda x: x > close)) + len(list_filter(l, lambda x: x = close)) / 2) / len(l), 6) END AS percentile FROM g""")
def wn26_trailing_percentile(spark, d):
    return rounded(order_statistics.trailing_percentile(bars_1d(spark, d), "symbol", "day", "close", 365, 180, "percentile").select("symbol", "day", "percentile"), "percentile")


@query(f"""WITH {BARS_1D}, r AS (SELECT *, greatest(high - low, abs(high - lag(close) {OVER})), abs(low - lag(close) {OVER}))) AS tr FROM b),
g AS (SELECT *, avg(tr) {rows(14)} AS atr, count(*) {rows(14)} AS n, lag(high, 2) {OVER}) AS left_high, lag(open) {OVER}) AS po, lag(close) {OVER}) AS pc, lag(high) {OVER}) AS ph, lag(low) {OVER}) AS pl FROM r)
SELECT symbol, day, coalesce(n = 14 AND low - left_high >= 0.15::DOUBLE * atr, false) AS gap, round(CASE WHEN n = 14 AND low - left_high >= 0.15::DOUBLE * atr THEN (low + left_high) / 2 END, 6) AS gap_middle,
  coalesce(n = 14 AND pc < po AND close > open AND close - open >= atr, false) AS block, round(CASE WHEN n = 14 AND pc < po AND close > open AND close - open >= atr THEN (ph + pl) / 2 END, 6) AS block_middle FROM g""")
def wn40_41_price_patterns(spark, d):
    """Fair-value gaps and order blocks, known at the close of the bar that completes them."""
    g = I.price_patterns(bars_1d(spark, d), "symbol", "day", 14, 0.15, 1.0)
    return rounded(g.select("symbol", "day", "gap", "gap_middle", "block", "block_middle"), "gap_middle", "block_middle")


@query(f"""WITH {BARS_1D}, g AS (SELECT symbol, day, close / lag(close) {OVER}) - 1 AS r, CASE WHEN count(*) {rows(30, 1)} = 30 THEN volume / quantile_cont(volume, 0.5) {rows(30, 1)} END AS rel, lead(open, 2) {OVER}) / lead(open, 1) {OVER}) - 1 AS fwd FROM b),
k AS (SELECT *, CASE WHEN rel >= 1 THEN 'high' ELSE 'low' END AS bucket FROM g WHERE r IS NOT NULL AND rel IS NOT NULL AND fwd IS NOT NULL)
SELECT day, bucket, symbol, round(fwd, 6) AS forward FROM (SELECT *, row_number() OVER (PARTITION BY day, bucket ORDER BY r, symbol) AS i FROM k) WHERE i = 1""")
def pf02_reversal_by_volume(spark, d):
    """The day's worst symbol among those of low and of high relative volume."""
    b = bars_1d(spark, d)
    g = b.select("symbol", "day", (F.col("close") / F.lag("close").over(W()) - 1).alias("r"), I.relative_to_median("volume", 30, W()).alias("rel"), (F.lead("open", 2).over(W()) / F.lead("open", 1).over(W()) - 1).alias("forward"))
    k = g.dropna().withColumn("bucket", F.when(F.col("rel") >= 1, "high").otherwise("low"))
    best = k.withColumn("i", F.row_number().over(Window.partitionBy("day", "bucket").orderBy("r", "symbol"))).where("i = 1")
    return rounded(best.select("day", "bucket", "symbol", "forward"), "forward")


@query(f"""WITH {BARS_1D}, m AS (SELECT symbol, day, close / lag(close, 20) {OVER}) - 1 AS s FROM b), p AS (SELECT day, x.s AS s1, y.s AS s2 FROM m x JOIN m y USING (day) WHERE x.symbol = 'S0' AND y.symbol = 'S1' AND x.s IS NOT NULL AND y.s IS NOT NULL)
SELECT day, round(least(greatest(0.5 + 0.25 * (s1 - s2), 0.25), 0.75), 6) AS w1, round(1 - least(greatest(0.5 + 0.25 * (s1 - s2), 0.25), 0.75), 6) AS w2 FROM p""")
def pf06_tilted_pair(spark, d):
    m = bars_1d(spark, d).select("symbol", "day", (F.col("close") / F.lag("close", 20).over(W()) - 1).alias("s"))
    return rounded(selection.tilted_pair(m, "day", "symbol", "s", "S0", "S1"), "w1", "w2")


ARMS = """z AS (SELECT *, CASE WHEN o_orderkey * 7 % 101 >= 70 THEN 1 WHEN o_orderkey * 7 % 101 >= 30 THEN 0.5 ELSE 0 END AS weight FROM t)"""


def overlaid(spark, d):
    score = F.col("o_orderkey") * 7 % 101 / 100
    return trades(spark, d).withColumn("weight", walkforward.banded_weight(score, [(0.7, 1.0), (0.3, 0.5)]))


@query(f"""WITH {TRADES}, {ARMS} SELECT (entry - 8000) // 180 AS fold, count(*) AS n, round(sum(net), 2) AS base, round(sum(weight * net), 2) AS overlay, round(avg(weight * net - net), 4) AS difference,
  sum((weight = 0 AND net > 0)::INT)::BIGINT AS vetoed_winners, sum((weight = 0 AND net <= 0)::INT)::BIGINT AS vetoed_losers FROM z GROUP BY 1""")
def pf09_entry_overlay(spark, d):
    g = walkforward.overlay_by_fold(overlaid(spark, d).withColumn("fold", F.expr("(entry - 8000) div 180")), "fold", "net", "weight")
    return g.select("fold", "n", F.round("base", 2).alias("base"), F.round("overlay", 2).alias("overlay"), F.round("difference", 4).alias("difference"), "vetoed_winners", "vetoed_losers")


@query(f"""WITH {TRADES}, c AS (SELECT unnest([0, 5, 10, 20, 50, 100, 200, 500]) AS bps), r AS (SELECT symbol, bps, sum(gross - bps / 10000.0::DOUBLE * qty * (entry_price + exit_price)) AS net FROM t, c GROUP BY 1, 2)
SELECT symbol, max(CASE WHEN net > 0 THEN bps END) AS last_positive, min(CASE WHEN net < 0 THEN bps END) AS first_negative FROM r GROUP BY 1""")
def pf16_break_even(spark, d):
    t = trades(spark, d).withColumn("traded", F.col("qty") * (F.col("entry_price") + F.col("exit_price")))
    return walkforward.break_even(t, "symbol", "gross", "traded", [0, 5, 10, 20, 50, 100, 200, 500])


@query(f"""WITH {BARS_1D}, g AS (SELECT *, count(*) {rows(20, 1)} AS n, max(high) {rows(20, 1)} AS hi, min(low) {rows(20, 1)} AS lo FROM b),
h AS (SELECT *, coalesce(last_value(CASE WHEN n = 20 AND close > hi THEN 1 WHEN n = 20 AND close < lo THEN 0 END IGNORE NULLS) {OVER} ROWS UNBOUNDED PRECEDING), 0) AS pos FROM g),
x AS (SELECT symbol, day, pos * (lead(close) {OVER}) / close - 1) - 0.001::DOUBLE * abs(pos - coalesce(lag(pos) {OVER}), 0)) AS r FROM h)
SELECT symbol, CASE WHEN day < 9500 THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, round(avg(r), 8) AS mean, round(stddev_samp(r), 8) AS deviation FROM x WHERE r IS NOT NULL GROUP BY 1, 2""")
def pf18_rule_returns(spark, d):
    """Long from a 20-bar breakout until a breakdown; close-to-close returns less the cost of turnover."""
    side = I.beyond_prior(20, W())
    h = bars_1d(spark, d).withColumn("side", side)
    h = h.withColumn("pos", I.hysteresis(F.col("side") == 1, F.col("side") == -1, W()))
    x = walkforward.rule_returns(h, "symbol", "day", "close", "pos", 0.001).where("ret is not null")
    return x.groupBy("symbol", F.when(F.col("day") < 9500, "train").otherwise("holdout").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 8).alias("mean"), F.round(F.stddev_samp("ret"), 8).alias("deviation"))


@query(f"""WITH {BARS_1D}, r AS (SELECT symbol, day, close / lag(close) {OVER}) - 1 AS r FROM b), f AS (SELECT unnest(range(8400, 10200, 180)) AS start),
x AS (SELECT start, CASE WHEN day < start - 5 THEN 'train' ELSE 'valid' END AS role, r FROM r JOIN f ON day < start - 5 OR (day >= start AND day < start + 180) WHERE r IS NOT NULL)
SELECT start AS fold, role, count(*) AS n, round(avg(r), 8) AS mean FROM x GROUP BY 1, 2""")
def ml01_walk_forward(spark, d):
    """Expanding training rows up to an embargo of 5 days before each fold of 180 days (also ML-20)."""
    r = bars_1d(spark, d).select("symbol", "day", (F.col("close") / F.lag("close").over(W()) - 1).alias("r")).where("r is not null")
    sums = walkforward.fold_sums(r, "day", "r", list(range(8400, 10200, 180)), 180, 5)
    return sums.select("fold", "role", "n", F.round(F.col("total") / F.col("n"), 8).alias("mean"))


@query(f"""WITH {BARS_1D}, r AS (SELECT symbol, day, round(close / lag(close) {OVER}) - 1, 9) AS r FROM b), q AS (SELECT symbol, round(quantile_cont(r, 1.0::DOUBLE / 3), 9) AS lo, round(quantile_cont(r, 2.0::DOUBLE / 3), 9) AS hi FROM r WHERE day < 9500 GROUP BY 1)
SELECT symbol, day, (CASE WHEN r <= lo THEN 0 WHEN r <= hi THEN 1 ELSE 2 END)::INTEGER AS class FROM r JOIN q USING (symbol) WHERE r IS NOT NULL""")
def ml23_tercile_classes(spark, d):
    """Classes of returns (to nine places) by the training rows' terciles."""
    r = bars_1d(spark, d).select("symbol", "day", F.round(F.col("close") / F.lag("close").over(W()) - 1, 9).alias("r"))
    return walkforward.tercile_classes(r, "symbol", "r", F.col("day") < 9500, 9).where("r is not null").select("symbol", "day", "class")


W4 = "OVER (PARTITION BY symbol ORDER BY slot"


@query(f"""WITH {BARS_4H}, g AS (SELECT *, ln(close / lag(close) {W4})) AS lr FROM b4)
SELECT symbol, slot, round(close / lag(close, 6) {W4}) - 1, 6) AS ret_24h, round(close / lag(close, 18) {W4}) - 1, 6) AS ret_72h, round(close / lag(close, 42) {W4}) - 1, 6) AS ret_168h,
  CASE WHEN count(lr) {W4} ROWS BETWEEN 41 PRECEDING AND CURRENT ROW) = 42 THEN round(stddev_pop(lr) {W4} ROWS BETWEEN 41 PRECEDING AND CURRENT ROW), 6) END AS vol_7d FROM g""")
def wn35_market_state(spark, d):
    """Returns over 6, 18 and 42 completed bars and the deviation of the last 42 log returns, null until the window is full."""
    w = Window.partitionBy("symbol").orderBy("slot")
    g = bars_4h(spark, d).withColumn("lr", F.log(F.col("close") / F.lag("close").over(w)))
    week = I.last_rows(w, 42)
    over = {f"ret_{4 * n}h": F.col("close") / F.lag("close", n).over(w) - 1 for n in (6, 18, 42)}
    state = g.withColumns({**over, "vol_7d": F.when(F.count("lr").over(week) == 42, F.stddev_pop("lr").over(week))})
    return rounded(state.select("symbol", "slot", *over, "vol_7d"), *over, "vol_7d")
