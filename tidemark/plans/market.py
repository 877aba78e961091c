"""Queries over bars, settlements and universes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import indicators as I
from tidemark.operators import selection, sliding, timeline
from tidemark.plans.demo import BARS_1D, BARS_4H, SETTLEMENTS, bars_1d, bars_4h, settlements
from tidemark.plans.registry import query, rounded



def W():  # noqa: N802
    """Daily bars in order; made on use, as a window needs a session."""
    return Window.partitionBy("symbol").orderBy("day")


def W4():  # noqa: N802
    return Window.partitionBy("symbol").orderBy("slot")


OVER = "OVER (PARTITION BY symbol ORDER BY day"


def rows(n: int, skip: int = 0) -> str:
    return f"{OVER} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


@query(f"""WITH {BARS_1D},
u AS (SELECT *, sum(turnover) OVER w AS liq, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY liq DESC, symbol) AS rank FROM u WHERE n = 30) WHERE rank <= 3),
x AS (SELECT *, max(high) {rows(20, 1)} AS hi, count(*) {rows(20, 1)} AS c, lag(close, 20) {OVER}) AS ago, lead(open, 1) {OVER}) AS o1, lead(open, 2) {OVER}) AS o2 FROM b)
SELECT v.day, v.symbol, v.rank, round(x.close / x.ago - 1, 6) AS momentum, row_number() OVER (PARTITION BY v.day ORDER BY x.close / x.ago - 1 DESC, v.symbol) AS place, round(x.o2 / x.o1 - 1, 6) AS forward
FROM v JOIN x USING (symbol, day) WHERE x.c = 20 AND x.close > x.hi AND x.ago IS NOT NULL""")
def flagship_breakout(spark, d):
    """Top 3 liquid symbols of each day with a 20-bar breakout, ranked by momentum, with the next bar's open-to-open return."""
    b = bars_1d(spark, d)
    top = selection.liquid_universe(b, 3, 30).select("symbol", "day", "rank")
    x = b.select(
        "symbol", "day", (I.beyond_prior(20, W()) == 1).alias("out"), (F.col("close") / F.lag("close", 20).over(W()) - 1).alias("momentum"), (F.lead("open", 2).over(W()) / F.lead("open", 1).over(W()) - 1).alias("forward")
    ).where("out and momentum is not null")
    j = top.join(x.drop("out"), ["symbol", "day"]).withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("momentum"), "symbol")))
    return rounded(j.select("day", "symbol", "rank", "momentum", "place", "forward"), "momentum", "forward")


@query(f"""WITH {BARS_1D}, u AS (SELECT *, sum(turnover) OVER w AS liq, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT symbol, day, round(liq, 4) AS liquidity, rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY liq DESC, symbol) AS rank FROM u WHERE n = 30) WHERE rank <= 2""")
def tk01_liquid_universe(spark, d):
    return selection.liquid_universe(bars_1d(spark, d), 2, 30).select("symbol", "day", F.round("liquidity", 4).alias("liquidity"), "rank")


@query(f"""WITH {BARS_1D} SELECT symbol, day, CASE WHEN count(*) {rows(10)} = 10 THEN round(avg(close) {rows(10)}, 6) END AS sma FROM b""")
def wn01_sma(spark, d):
    return bars_1d(spark, d).select("symbol", "day", F.round(I.sma("close", 10, W()), 6).alias("sma"))


RSI = f"""c AS (SELECT *, close - lag(close) {OVER}) AS ch FROM b), g AS (SELECT *, count(ch) {rows(14)} AS n, sum(greatest(ch, 0)) {rows(14)} AS up, sum(greatest(-ch, 0)) {rows(14)} AS dn FROM c),
q AS (SELECT symbol, day, CASE WHEN n = 14 THEN CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END END AS rsi FROM g)"""


@query(f"WITH {BARS_1D}, {RSI} SELECT symbol, day, round(rsi, 6) AS rsi FROM q")
def wn03_rsi(spark, d):
    return I.with_change(bars_1d(spark, d), "close", W()).select("symbol", "day", F.round(I.rsi("close", 14, W()), 6).alias("rsi"))


@query(f"WITH {BARS_1D}, {RSI} SELECT symbol, day FROM (SELECT *, lag(rsi) {OVER}) AS p FROM q) WHERE p < 30 AND rsi >= 30")
def wn13_rsi_cross(spark, d):
    r = I.with_change(bars_1d(spark, d), "close", W()).select("symbol", "day", I.rsi("close", 14, W()).alias("rsi"))
    return r.withColumn("p", F.lag("rsi").over(W())).where("p < 30 and rsi >= 30").select("symbol", "day")


@query(f"""WITH {BARS_1D}, r AS (SELECT *, greatest(high - low, abs(high - lag(close) {OVER})), abs(low - lag(close) {OVER}))) AS tr FROM b)
SELECT symbol, day, round(tr, 6) AS tr, CASE WHEN count(*) {rows(14)} = 14 THEN round(avg(tr) {rows(14)}, 6) END AS atr FROM r""")
def wn05_atr(spark, d):
    r = bars_1d(spark, d).withColumn("tr", I.true_range(W()))
    return rounded(r.select("symbol", "day", "tr", I.sma("tr", 14, W()).alias("atr")), "tr", "atr")


@query(f"""WITH {BARS_1D}, r AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
g AS (SELECT *, count(*) {rows(14)} AS n14, min(low) {rows(14)} AS lo, max(high) {rows(14)} AS hi, count(*) {rows(20)} AS n20, avg(tp) {rows(20)} AS m, list(tp) {rows(20)} AS l FROM r),
h AS (SELECT *, list_sum(list_transform(l, lambda x: abs(x - m))) / 20 AS dev FROM g)
SELECT symbol, day, CASE WHEN n14 = 14 THEN round(CASE WHEN hi = lo THEN 50 ELSE 100 * (close - lo) / (hi - lo) END, 6) END AS k, CASE WHEN n20 = 20 THEN round(CASE WHEN dev = 0 THEN 0 ELSE (tp - m) / (0.015::DOUBLE * dev) END, 6) END AS cci FROM h""")
def wn08_stochastic_cci(spark, d):
    r = bars_1d(spark, d).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return rounded(r.select("symbol", "day", I.stochastic(14, W()).alias("k"), I.cci(20, W()).alias("cci")), "k", "cci")


@query(f"""WITH {BARS_1D}, g AS (SELECT *, CASE WHEN count(*) {rows(5)} = 5 THEN avg(close) {rows(5)} END AS f, CASE WHEN count(*) {rows(20)} = 20 THEN avg(close) {rows(20)} END AS s FROM b),
x AS (SELECT *, coalesce(f > s * 1.01::DOUBLE, false) AS up, coalesce(f < s * 0.99::DOUBLE, false) AS dn FROM g),
y AS (SELECT *, count(*) {rows(2)} = 2 AND bool_and(up) {rows(2)} AS entry, count(*) {rows(2)} = 2 AND bool_and(dn) {rows(2)} AS exit FROM x)
SELECT symbol, day, entry, exit, coalesce(last_value(CASE WHEN entry THEN 1 WHEN exit THEN 0 END IGNORE NULLS) {OVER} ROWS UNBOUNDED PRECEDING), 0)::INTEGER AS held FROM y""")
def wn09_average_cross_held(spark, d):
    """Moving-average cross with two bars of persistence, and the position by hysteresis (also WN-14, WN-27)."""
    g = bars_1d(spark, d).withColumn("f", I.sma("close", 5, W())).withColumn("s", I.sma("close", 20, W()))
    g = g.withColumn("entry", I.persists(F.col("f") > F.col("s") * 1.01, 2, W())).withColumn("exit", I.persists(F.col("f") < F.col("s") * 0.99, 2, W()))
    return g.select("symbol", "day", "entry", "exit", I.hysteresis(F.col("entry"), F.col("exit"), W()).alias("held"))


@query(f"""WITH {BARS_1D}, g AS (SELECT *, count(*) {rows(10, 1)} AS n, max(high) {rows(10, 1)} AS hi, min(low) {rows(10, 1)} AS lo FROM b)
SELECT symbol, day, coalesce(n = 10 AND close >= lo * 1.05::DOUBLE, false) AS filter_rule, coalesce(n = 10 AND hi / lo - 1 <= 0.8::DOUBLE AND close > hi * 1.001::DOUBLE, false) AS channel,
  (CASE WHEN n < 10 THEN 0 WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE 0 END)::INTEGER AS beyond FROM g""")
def wn10_12_breakout_rules(spark, d):
    """Filter rule, compressed channel and support / resistance breakout."""
    return bars_1d(spark, d).select("symbol", "day", I.above_prior_low(10, 0.05, W()).alias("filter_rule"), I.channel_breakout(10, 0.8, 0.001, W()).alias("channel"), I.beyond_prior(10, W()).alias("beyond"))


@query(f"""WITH {BARS_1D}, g AS (SELECT *, lag(close, 7) {OVER}) AS p, lag(close, 14) {OVER}) AS q FROM b)
SELECT symbol, day, CASE WHEN q IS NULL THEN NULL WHEN close >= p AND p >= q THEN 'bull' WHEN close <= p AND p <= q THEN 'bear' ELSE 'side' END AS regime FROM g""")
def wn15_two_week_regime(spark, d):
    return bars_1d(spark, d).select("symbol", "day", I.regime_by_rows("close", W()).alias("regime"))


@query(f"""WITH {BARS_1D}, g AS (SELECT *, ln(close / lag(close) {OVER})) AS lr, close / lag(close, 14) {OVER}) - 1 AS r14 FROM b),
v AS (SELECT *, CASE WHEN count(lr) {rows(30)} = 30 THEN stddev_pop(lr) {rows(30)} * sqrt(365) END AS vol FROM g), m AS (SELECT symbol, quantile_cont(vol, 0.5) AS med FROM v GROUP BY 1)
SELECT symbol, day, CASE WHEN r14 >= 0.1::DOUBLE THEN 'up' WHEN r14 <= -0.1::DOUBLE THEN 'down' ELSE 'flat' END || CASE WHEN vol > med THEN '_high' ELSE '_low' END AS label FROM v JOIN m USING (symbol) WHERE vol IS NOT NULL AND r14 IS NOT NULL""")
def wn16_trend_volatility(spark, d):
    g = bars_1d(spark, d).withColumn("lr", F.log(F.col("close") / F.lag("close").over(W()))).withColumn("r14", F.col("close") / F.lag("close", 14).over(W()) - 1)
    v = g.withColumn("vol", F.when(F.count("lr").over(I.last_rows(W(), 30)) == 30, F.stddev_pop("lr").over(I.last_rows(W(), 30)) * 365**0.5))
    v = v.join(v.groupBy("symbol").agg(F.percentile("vol", 0.5).alias("med")), "symbol").where("vol is not null and r14 is not null")
    trend = F.when(F.col("r14") >= 0.1, "up").when(F.col("r14") <= -0.1, "down").otherwise("flat")
    return v.select("symbol", "day", F.concat(trend, F.when(F.col("vol") > F.col("med"), "_high").otherwise("_low")).alias("label"))


@query(f"""WITH {BARS_1D}, g AS (SELECT *, 1 - close / max(close) {OVER} ROWS UNBOUNDED PRECEDING) AS dd FROM b) SELECT symbol, (day - 8000) // 180 AS fold, round(max(dd), 6) AS max_drawdown FROM g GROUP BY 1, 2""")
def wn19_drawdown_by_fold(spark, d):
    """Running drawdown, largest per fold of 180 days (also WN-43)."""
    g = bars_1d(spark, d).withColumn("dd", I.drawdown("close", W()))
    return g.groupBy("symbol", F.expr("(day - 8000) div 180").alias("fold")).agg(F.round(F.max("dd"), 6).alias("max_drawdown"))


@query(f"""WITH {BARS_1D} SELECT symbol, day, round(close / lag(close) {OVER}) - 1, 6) AS ret, round(lag(close, 2) {OVER}) / lag(close, 12) {OVER}) - 1, 6) AS momentum FROM b""")
def wn20_21_returns_momentum(spark, d):
    return rounded(bars_1d(spark, d).select("symbol", "day", (F.col("close") / F.lag("close").over(W()) - 1).alias("ret"), (F.lag("close", 2).over(W()) / F.lag("close", 12).over(W()) - 1).alias("momentum")), "ret", "momentum")


@query(f"""WITH {SETTLEMENTS}, g AS (SELECT symbol, sec, event_id, CASE WHEN sec - lag(sec) OVER w > 3600 OR lag(sec) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY symbol ORDER BY sec, event_id))
SELECT symbol, cluster, min(sec) AS first, max(sec) AS last, count(*) AS n FROM (SELECT symbol, sec, sum(new) OVER (PARTITION BY symbol ORDER BY sec)::BIGINT AS cluster FROM g) GROUP BY 1, 2""")
def wn30_gap_clusters(spark, d):
    c = timeline.cluster_by_gap(settlements(spark, d), "symbol", "sec", 3600)
    return c.groupBy("symbol", "cluster").agg(F.min("sec").alias("first"), F.max("sec").alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BARS_1D}, x AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY turnover DESC, symbol) AS u, row_number() OVER (PARTITION BY day ORDER BY turnover, symbol) AS v FROM b),
y AS (SELECT symbol, day, (CASE WHEN u <= 1 THEN 0.5 WHEN v <= 1 THEN -0.5 ELSE 0 END)::DOUBLE AS w FROM x)
SELECT day, round(sum(abs(w - coalesce(pw, 0))), 6) AS turnover FROM (SELECT *, lag(w) {OVER}) AS pw FROM y) GROUP BY 1""")
def wn31_factor_turnover(spark, d):
    """Long the most, short the least traded symbol; turnover of the weights (also TK-03)."""
    w = selection.top_and_bottom(bars_1d(spark, d), ["day"], "turnover", "symbol", 1).select("symbol", "day", (F.col("side") * 0.5).alias("w"))
    return rounded(I.turnover(w, "symbol", "day", "w"), "turnover")


@query(f"""WITH {BARS_1D}, g AS (SELECT *, count(*) {rows(30, 1)} AS n, avg(volume) {rows(30, 1)} AS m, stddev_pop(volume) {rows(30, 1)} AS sd, quantile_cont(volume, 0.5) {rows(30, 1)} AS med FROM b)
SELECT symbol, day, round(CASE WHEN n = 30 AND sd > 0 THEN (volume - m) / sd END, 6) AS z, round(CASE WHEN n = 30 THEN volume / med END, 6) AS relative FROM g""")
def wn32_33_volume(spark, d):
    return rounded(bars_1d(spark, d).select("symbol", "day", I.zscore_before("volume", 30, W()).alias("z"), I.relative_to_median("volume", 30, W()).alias("relative")), "z", "relative")


@query(f"""WITH {BARS_1D}, g AS (SELECT *, abs(close / lag(close) {OVER}) - 1) / turnover AS illiq FROM b), h AS (SELECT *, count(illiq) {rows(20, 1)} AS n, quantile_cont(illiq, 0.5) {rows(20, 1)} AS med FROM g)
SELECT symbol, day, round(illiq / med, 6) AS shock FROM h WHERE n = 20 AND med > 0""")
def wn34_illiquidity_shock(spark, d):
    g = bars_1d(spark, d).withColumn("illiq", F.abs(F.col("close") / F.lag("close").over(W()) - 1) / F.col("turnover"))
    f = I.last_rows(W(), 20, 1)
    h = g.withColumn("n", F.count("illiq").over(f)).withColumn("med", F.percentile("illiq", 0.5).over(f)).where("n = 20 and med > 0")
    return h.select("symbol", "day", F.round(F.col("illiq") / F.col("med"), 6).alias("shock"))


@query(f"""WITH {BARS_1D} SELECT symbol, day, next - day AS step FROM (SELECT symbol, day, lead(day) {OVER}) AS next FROM b) WHERE next - day <> 1""")
def wn39_contiguity(spark, d):
    return bars_1d(spark, d).select("symbol", "day", (F.lead("day").over(W()) - F.col("day")).alias("step")).where("step <> 1")


@query(f"""WITH {BARS_1D}, g AS (SELECT symbol, day, close, row_number() {OVER}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM b) SELECT symbol, (pos * 5) // n AS part, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY 1, 2""")
def wn44_equal_parts(spark, d):
    g = bars_1d(spark, d).withColumn("pos", F.row_number().over(W()) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return g.groupBy("symbol", I.equal_parts(F.col("pos"), F.col("n"), 5).alias("part")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BARS_4H}, s AS (SELECT symbol, us // 1000000 AS sec, (price - 20) / 10000 AS rate FROM ticks), r AS (SELECT symbol, sec, max(rate) AS rate FROM s GROUP BY 1, 2),
q AS (SELECT symbol, slot, (slot + 1) * 14400 AS sec FROM b4)
SELECT q.symbol, q.slot, round(r.rate, 6) AS rate FROM q ASOF LEFT JOIN r ON q.symbol = r.symbol AND q.sec >= r.sec""")
def jn04_asof(spark, d):
    left = bars_4h(spark, d).select("symbol", ((F.col("slot") + 1) * 14400).alias("sec"), "slot")
    return rounded(timeline.asof_join(left, settlements(spark, d).select("symbol", "sec", "rate"), "symbol", "sec", ["rate"]).select("symbol", "slot", "rate"), "rate")


@query(f"""WITH {BARS_4H}, s AS (SELECT symbol, us // 1000000 AS sec, (price - 20) / 10000 AS rate FROM ticks), q AS (SELECT symbol, slot, (slot + 1) * 14400 AS sec FROM b4)
SELECT q.symbol, q.slot, round(sum(s.rate), 6) AS funding, count(s.rate) AS funding_n FROM q LEFT JOIN s ON s.symbol = q.symbol AND s.sec > q.sec - 259200 AND s.sec <= q.sec GROUP BY 1, 2""")
def jn06_interval_sum(spark, d):
    left = bars_4h(spark, d).select("symbol", ((F.col("slot") + 1) * 14400).alias("sec"), "slot")
    out = timeline.interval_sum(left, settlements(spark, d), "symbol", "sec", "rate", 3 * 86400, "right", "funding")
    return rounded(out.select("symbol", "slot", "funding", "funding_n"), "funding")


@query(f"""WITH {BARS_4H}, e AS (SELECT symbol, event_id, us // {14400}000000 AS slot FROM ticks)
SELECT e.event_id, e.symbol, y.open / x.open - 1 AS forward FROM e JOIN b4 x ON x.symbol = e.symbol AND x.slot = e.slot + 1 JOIN b4 y ON y.symbol = e.symbol AND y.slot = e.slot + 7""")
def jn02_forward_return(spark, d):
    from tidemark.plans.demo import ticks

    e = ticks(spark, d).select("symbol", "event_id", F.expr("us div 14400000000").alias("slot"))
    return timeline.forward_return(e, bars_4h(spark, d), "symbol", "slot", 1, 6).select("event_id", "symbol", "forward")  # a quotient of cents: both sides give the same double, which may lie on the edge of rounding


@query(f"""WITH {BARS_4H}, e AS (SELECT symbol, event_id, us // {14400}000000 AS slot FROM ticks)
SELECT e.event_id, e.symbol, y.open / x.open - 1 AS forward FROM e JOIN b4 x ON x.symbol = e.symbol AND x.slot = e.slot + 1 JOIN b4 y ON y.symbol = e.symbol AND y.slot = e.slot + 7""")
def jn02_forward_return_of_all(spark, d):
    """The forward return of every tick."""
    from tidemark.plans.demo import ticks

    e = ticks(spark, d).select("symbol", "event_id", F.expr("us div 14400000000").alias("slot"))
    return timeline.forward_return(e, bars_4h(spark, d), "symbol", "slot", 1, 6).select("event_id", "symbol", "forward")  # a quotient of cents: both sides give the same double, which may lie on the edge of rounding


HORIZONS = [1, 3, 6, 18]  # bars: 4, 12, 24 and 72 hours


@query(" UNION ALL ".join(f"""SELECT symbol, slot, {h} AS horizon, c / open - 1 AS ret, hi / open - 1 AS best, lo / open - 1 AS worst, round(sqrt(v), 6) AS vol FROM (
  SELECT symbol, slot, open, count(*) OVER w AS n, last_value(close) OVER w AS c, max(high) OVER w AS hi, min(low) OVER w AS lo, sum(ln(close / open) ** 2) OVER w AS v FROM b4
  WINDOW w AS (PARTITION BY symbol ORDER BY slot RANGE BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)) WHERE n = {h}""" for h in HORIZONS).join([f"WITH {BARS_4H} ", ""]))
def jn03_path_targets(spark, d):
    """Return, excursions and volatility of every bar's next 4, 12, 24 and 72 hours, in one pass."""
    return rounded(sliding.path_targets(bars_4h(spark, d), "symbol", "slot", HORIZONS), "vol")  # quotients of cents may lie on the edge of rounding; both sides give the same double


@query(f"""WITH {BARS_4H}, f AS (SELECT slot FROM b4 GROUP BY 1 HAVING count(DISTINCT symbol) = 5) SELECT slot, count(*) AS n, round(avg(close), 6) AS mean_close FROM b4 SEMI JOIN f USING (slot) GROUP BY 1""")
def jn14_common_times(spark, d):
    return rounded(timeline.common_times(bars_4h(spark, d), "symbol", "slot", 5).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close")), "mean_close")


@query(f"""WITH {BARS_1D}, g AS (SELECT *, close / lag(close, 20) {OVER}) - 1 AS mom FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY turnover DESC, symbol) + row_number() OVER (PARTITION BY day ORDER BY mom DESC, symbol) AS rs FROM g WHERE mom IS NOT NULL)
SELECT symbol, day, rs AS rank_sum, row_number() OVER (PARTITION BY day ORDER BY rs, symbol) <= ceil(count(*) OVER (PARTITION BY day) / 3) AS chosen FROM k""")
def tk04_rank_sum(spark, d):
    g = bars_1d(spark, d).withColumn("mom", F.col("close") / F.lag("close", 20).over(W()) - 1).where("mom is not null")
    return selection.rank_sum(g, ["day"], ["turnover", "mom"], "symbol").select("symbol", "day", F.col("rank_sum").cast("long").alias("rank_sum"), "chosen")


@query(f"""WITH {BARS_1D}, g AS (SELECT symbol, day, close / lag(close, 5) {OVER}) - 1 AS mom, lead(open, 2) {OVER}) / lead(open, 1) {OVER}) - 1 AS fwd FROM b)
SELECT day, round(avg(CASE WHEN u <= 2 THEN fwd END) - avg(CASE WHEN v <= 2 THEN fwd END), 6) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY mom DESC, symbol) AS u, row_number() OVER (PARTITION BY day ORDER BY mom, symbol) AS v FROM g WHERE mom IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1 HAVING count(*) = 5""")
def pf01_momentum_factor(spark, d):
    """Two winners long, two losers short, next day's open-to-open return."""
    g = bars_1d(spark, d).select("symbol", "day", (F.col("close") / F.lag("close", 5).over(W()) - 1).alias("mom"), (F.lead("open", 2).over(W()) / F.lead("open", 1).over(W()) - 1).alias("fwd")).where("mom is not null and fwd is not null")
    s = selection.top_and_bottom(g, ["day"], "mom", "symbol", 2)
    out = s.groupBy("day").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.when(F.col("side") == 1, F.col("fwd"))) - F.avg(F.when(F.col("side") == -1, F.col("fwd")))).alias("spread"))
    return rounded(out.where("n = 5").select("day", "spread"), "spread")


@query(f"""WITH {BARS_1D}, g AS (SELECT *, ln(close / lag(close) {OVER})) AS lr FROM b), v AS (SELECT symbol, day, count(lr) {rows(20)} AS n, 1 / greatest(stddev_pop(lr) {rows(20)}, 1e-6::DOUBLE) AS w FROM g)
SELECT symbol, day, round(w / sum(w) OVER (PARTITION BY day), 6) AS weight FROM v WHERE n = 20""")
def pf05_inverse_volatility(spark, d):
    g = bars_1d(spark, d).withColumn("lr", F.log(F.col("close") / F.lag("close").over(W())))
    f = I.last_rows(W(), 20)
    v = g.select("symbol", "day", F.count("lr").over(f).alias("n"), (1 / F.greatest(F.stddev_pop("lr").over(f), F.lit(1e-6))).alias("w")).where("n = 20")
    return v.select("symbol", "day", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("day")), 6).alias("weight"))


@query(f"""WITH {BARS_4H}, g AS (SELECT symbol, slot - lag(slot) OVER (PARTITION BY symbol ORDER BY slot) AS gap FROM b4), m AS (SELECT symbol, quantile_cont(gap, 0.5) AS med FROM g GROUP BY 1)
SELECT symbol, sum(greatest(0, round(gap / med) - 1))::BIGINT AS missing FROM g JOIN m USING (symbol) WHERE gap IS NOT NULL GROUP BY 1""")
def ag40_missing_intervals(spark, d):
    g = bars_4h(spark, d).select("symbol", (F.col("slot") - F.lag("slot").over(W4())).alias("gap"))
    m = g.groupBy("symbol").agg(F.percentile("gap", 0.5).alias("med"))
    return g.join(m, "symbol").where("gap is not null").groupBy("symbol").agg(F.sum(F.greatest(F.lit(0), F.round(F.col("gap") / F.col("med")) - 1)).cast("long").alias("missing"))


@query(f"""WITH {BARS_4H} SELECT symbol, us // 3600000000 AS hour, round((sum(CASE WHEN side = 'buy' THEN price * qty ELSE 0 END) - sum(CASE WHEN side = 'sell' THEN price * qty ELSE 0 END)) / sum(price * qty), 6) AS imbalance FROM ticks GROUP BY 1, 2""")
def ag32_flow_imbalance(spark, d):
    from tidemark.plans.demo import ticks

    v = F.col("price") * F.col("qty")
    return ticks(spark, d).groupBy("symbol", F.expr("us div 3600000000").alias("hour")).agg(F.round(F.sum(F.when(F.col("side") == "buy", v).otherwise(-v)) / F.sum(v), 6).alias("imbalance"))
