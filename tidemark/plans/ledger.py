"""Queries over trades, returns and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import indicators as I
from tidemark.operators import stats, timeline, touches
from tidemark.plans.demo import SETTLEMENTS, TRADES, bars_1d, settlements, trades
from tidemark.plans.registry import query, rounded
from tidemark.sources.readers import written


@query(f"""WITH {TRADES} SELECT symbol, reason, count(*) AS n, sum((net > 0)::INT)::BIGINT AS wins, round(avg((net > 0)::INT), 6) AS win_rate,
  round(CASE WHEN sum(CASE WHEN net < 0 THEN net ELSE 0 END) < 0 THEN sum(CASE WHEN net > 0 THEN net ELSE 0 END) / -sum(CASE WHEN net < 0 THEN net ELSE 0 END) END, 6) AS profit_factor,
  round(avg(CASE WHEN net > 0 THEN net END), 4) AS mean_win, round(-avg(CASE WHEN net < 0 THEN net END), 4) AS mean_loss, round(avg(CASE WHEN net > 0 THEN net END) / -avg(CASE WHEN net < 0 THEN net END), 6) AS reward_risk FROM t GROUP BY 1, 2""")
def ag22_trade_statistics(spark, d):
    s = stats.trade_statistics(trades(spark, d), ["symbol", "reason"])
    return rounded(s.withColumns({c: F.round(c, 4) for c in ("mean_win", "mean_loss")}), "win_rate", "profit_factor", "reward_risk")


@query(f"""WITH {TRADES} SELECT symbol, reason, count(*) AS n, round(sum(gross), 2) AS gross, round(sum(fees), 2) AS fees, round(sum(net), 2) AS net, round(max(abs(gross - fees - net)), 6) AS error FROM t GROUP BY GROUPING SETS ((symbol, reason), (symbol), ())""")
def ag26_decomposition(spark, d):
    """P&L by symbol and reason with subtotals, and the reconciliation error (also PF-15)."""
    t = trades(spark, d)
    return t.groupingSets([["symbol", "reason"], ["symbol"], []], "symbol", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("gross"), 2).alias("gross"), F.round(F.sum("fees"), 2).alias("fees"), F.round(F.sum("net"), 2).alias("net"), F.round(F.max(F.abs(F.col("gross") - F.col("fees") - F.col("net"))), 6).alias("error")
    )


@query(f"""WITH {TRADES}, p AS (SELECT symbol, greatest(sum(net), 0) AS v FROM t GROUP BY 1), s AS (SELECT symbol, v / sum(v) OVER () AS share FROM p)
SELECT symbol, round(share, 6) AS share, round(sum(share * share) OVER (), 6) AS hhi FROM s""")
def ag28_concentration(spark, d):
    return rounded(stats.concentration(trades(spark, d), "symbol", "net"), "share", "hhi")


@query(f"WITH {TRADES}, p AS (SELECT symbol, sum(net) AS v FROM t GROUP BY 1) SELECT symbol, round(sum(v) OVER () - v, 2) AS without FROM p")
def ag30_leave_one_out(spark, d):
    return stats.leave_one_out(trades(spark, d), "symbol", "net").select("symbol", F.round("without", 2).alias("without"))


@query(f"""WITH {TRADES}, q AS (SELECT symbol, exit AS day, sum(net) / 1e9::DOUBLE AS r FROM t GROUP BY 1, 2)
SELECT symbol, round(exp(sum(ln(1 + r))) - 1, 6) AS total, round(avg(r) / stddev_samp(r) * sqrt(365), 6) AS sharpe, round(avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) * sqrt(365), 6) AS sortino FROM q GROUP BY 1""")
def ag23_return_statistics(spark, d):
    q = trades(spark, d).groupBy("symbol", F.col("exit").alias("day")).agg((F.sum("net") / 1e9).alias("r"))
    return rounded(stats.return_statistics(q, ["symbol"], "r", 365), "total", "sharpe", "sortino")


@query(f"""WITH {TRADES}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM t)
SELECT symbol, round(max(net), 2) AS var, round(avg(net), 2) AS cvar FROM x WHERE i <= greatest(floor(n * 0.05::DOUBLE) - 1, 0) GROUP BY 1""")
def ag24_value_at_risk(spark, d):
    v = stats.value_at_risk(trades(spark, d), ["symbol"], "net", "o_orderkey")
    return v.select("symbol", F.round("var", 2).alias("var"), F.round("cvar", 2).alias("cvar"))


@query(f"""WITH {TRADES}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net, o_orderkey) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM t)
SELECT symbol, round(avg(net), 2) AS shortfall, round(min(net), 2) AS worst FROM x WHERE i <= ceil(n * 0.1::DOUBLE) GROUP BY 1""")
def ag25_expected_shortfall(spark, d):
    v = stats.expected_shortfall(trades(spark, d), ["symbol"], "net", "o_orderkey")
    return v.select("symbol", F.round("shortfall", 2).alias("shortfall"), F.round("worst", 2).alias("worst"))


@query(f"""WITH {TRADES}, p AS (SELECT exit AS day, sum(net) AS pnl FROM t GROUP BY 1), s AS (SELECT unnest(range((SELECT min(day) FROM p), (SELECT max(day) FROM p) + 1)) AS day)
SELECT day, round(coalesce(pnl, 0), 2) AS pnl, round(1e9::DOUBLE + sum(coalesce(pnl, 0)) OVER (ORDER BY day), 2) AS equity FROM s LEFT JOIN p USING (day)""")
def ag43_daily_equity(spark, d):
    p = trades(spark, d).groupBy(F.col("exit").alias("day")).agg(F.sum("net").alias("pnl"))
    spine = p.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    s = spine.join(p, "day", "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))
    return s.select("day", F.round("pnl", 2).alias("pnl"), F.round(1e9 + F.sum("pnl").over(Window.partitionBy(F.lit(0)).orderBy("day")), 2).alias("equity"))


@query(f"""WITH {TRADES} SELECT o_orderkey, symbol, round(100000 + coalesce(sum(net) OVER (PARTITION BY symbol ORDER BY entry, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS equity FROM t""")
def wn37_equity_at_entry(spark, d):
    t = timeline.running_before(trades(spark, d).select("symbol", "entry", "o_orderkey", "net"), "symbol", "entry", ["o_orderkey"], {"earlier": F.col("net")})
    return t.select("o_orderkey", "symbol", F.round(100000 + F.col("earlier"), 2).alias("equity"))


@query(f"""WITH {TRADES}, g AS (SELECT symbol, net > 0 AS w, row_number() OVER (PARTITION BY symbol ORDER BY exit, o_orderkey) - row_number() OVER (PARTITION BY symbol, net > 0 ORDER BY exit, o_orderkey) AS g FROM t),
c AS (SELECT symbol, w, g, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT symbol, coalesce(max(CASE WHEN w THEN n END), 0) AS win, coalesce(max(CASE WHEN NOT w THEN n END), 0) AS loss FROM c GROUP BY 1""")
def wn38_streaks(spark, d):
    return I.streaks(trades(spark, d), "symbol", "exit", ["o_orderkey"], F.col("net") > 0)


@query(f"""WITH {TRADES}, x AS (SELECT t.o_orderkey, b.day, b.high, max(b.high) OVER (PARTITION BY t.o_orderkey ORDER BY b.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak, b.low, t.entry_price FROM t JOIN b ON b.symbol = t.symbol AND b.day >= t.entry AND b.day <= t.exit)
SELECT o_orderkey, min(day) AS stopped FROM x WHERE low <= greatest(entry_price * 0.5::DOUBLE, peak * 0.6::DOUBLE) GROUP BY 1""")
def wn29_trailing_stop(spark, d):
    """First bar of a trade whose low reaches the stop; the peak lags one bar (also JN-09)."""
    t = trades(spark, d).select("o_orderkey", "symbol", "entry_price", F.explode(F.sequence("entry", "exit")).alias("day"))
    x = t.join(bars_1d(spark, d).select("symbol", "day", "high", "low"), ["symbol", "day"])
    peak = F.max("high").over(Window.partitionBy("o_orderkey").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("stop", F.greatest(F.col("entry_price") * 0.5, peak * 0.6))
    return x.where("low <= stop").groupBy("o_orderkey").agg(F.min("day").alias("stopped"))


@query(f"""WITH {TRADES}, g AS (SELECT o_orderkey, min(CASE WHEN b.low <= entry_price * 0.7::DOUBLE THEN b.day END) AS s, min(CASE WHEN b.high >= entry_price * 1.5::DOUBLE THEN b.day END) AS p FROM t JOIN b ON b.symbol = t.symbol AND b.day > t.entry AND b.day <= t.exit GROUP BY 1)
SELECT o_orderkey, CASE WHEN s IS NULL AND p IS NULL THEN 'time' WHEN p IS NULL OR s <= p THEN 'stop' ELSE 'target' END AS touched, least(s, p) AS day FROM g""")
def wn28_first_touch(spark, d):
    """Whether a trade's stop, its target or its time comes first, and on which bar, found by jumping over blocks of bars; a stop wins a tie."""
    b = written(bars_1d(spark, d), "bars")  # a row a symbol and day
    t = trades(spark, d, b).withColumn("from", F.col("entry") + 1)
    g = touches.first_touch(t, b, "o_orderkey", "symbol", "day", "from", "exit", F.col("entry_price") * 0.7, F.col("entry_price") * 1.5, levels=1)  # lives of three weeks
    return g.select("o_orderkey", F.when(F.col("below"), "stop").when(F.col("above"), "target").otherwise("time").alias("touched"), "day")


@query(f"""WITH {SETTLEMENTS}, sp AS (SELECT symbol, event_id AS span, sec AS start, sec + 5400 AS stop FROM s) SELECT sp.span, count(*) AS n, round(sum(s.rate), 6) AS rate FROM sp JOIN s ON s.symbol = sp.symbol AND s.sec > sp.start AND s.sec < sp.stop GROUP BY 1""")
def jn08_events_in_spans(spark, d):
    """Count and sum of the settlements within 90 minutes after each."""
    return spans_of_90_minutes(spark, d)


def spans_of_90_minutes(spark, d):
    s = settlements(spark, d)
    inside = timeline.following_sum(s, s, "symbol", "sec", "rate", 5400, "total")
    return rounded(s.select("symbol", "sec", F.col("event_id").alias("span")).join(inside, ["symbol", "sec"]).select("span", F.col("total_n").alias("n"), F.col("total").alias("rate")), "rate")


@query(f"""WITH {SETTLEMENTS}, g AS (SELECT symbol, sec, count(*) AS n, sum(rate) AS rate FROM s GROUP BY 1, 2), x AS (SELECT symbol, sec, sum(n) OVER w AS n, sum(rate) OVER w AS rate FROM g WINDOW w AS (PARTITION BY symbol ORDER BY sec RANGE BETWEEN 1 FOLLOWING AND 5399 FOLLOWING))
SELECT event_id AS span, x.n::BIGINT AS n, round(x.rate, 6) AS rate FROM s JOIN x USING (symbol, sec) WHERE x.n > 0""")
def jn08_events_in_all_spans(spark, d):
    """The same by window sums."""
    return spans_of_90_minutes(spark, d)


TIERS = [(100_000.0, 0.005, 0.0), (250_000.0, 0.01, 500.0), (400_000.0, 0.02, 3000.0)]


@query("""SELECT o_orderkey, round(CASE WHEN o_totalprice <= 100000 THEN o_totalprice * 0.005::DOUBLE WHEN o_totalprice <= 250000 THEN o_totalprice * 0.01::DOUBLE - 500 WHEN o_totalprice <= 400000 THEN o_totalprice * 0.02::DOUBLE - 3000 END, 6) AS required FROM orders""")
def jn21_tiers(spark, d):
    from tidemark.sources.readers import table

    tiers = spark.createDataFrame(TIERS, "limit double, rate double, deduction double")
    return rounded(timeline.tier_lookup(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), tiers, "o_totalprice").select("o_orderkey", "required"), "required")


@query(f"""WITH {TRADES}, q AS (SELECT symbol, avg(net) AS m, stddev_samp(net) AS sd, count(*) AS n FROM t GROUP BY 1), p AS (SELECT symbol, 1 / (1 + abs(m) / (sd / sqrt(n))) AS p FROM q), r AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, symbol) + 1) * p AS a FROM p)
SELECT symbol, round(p, 6) AS p, round(least(1, max(a) OVER (ORDER BY p, symbol)), 6) AS adjusted FROM r""")
def ml13_holm(spark, d):
    q = trades(spark, d).groupBy("symbol").agg((1 / (1 + F.abs(F.avg("net")) / (F.stddev_samp("net") / F.sqrt(F.count(F.lit(1)))))).alias("p"))
    return rounded(stats.holm(q, "symbol", "p"), "p", "adjusted")


@query(f"""WITH {TRADES}, c AS (SELECT row_number() OVER (ORDER BY symbol, reason) - 1 AS i, sum(net) AS x FROM t GROUP BY symbol, reason), m AS (SELECT unnest(range(0, (1 << (SELECT count(*) FROM c)::BIGINT)::BIGINT)) AS m),
f AS (SELECT m, sum(CASE WHEN (m >> i) & 1 = 1 THEN -x ELSE x END) AS s FROM m, c GROUP BY 1) SELECT round(avg((abs(s) >= (SELECT abs(sum(x)) FROM c) * (1 - 1e-9::DOUBLE))::INT), 4) AS p FROM f""")
def ml12_sign_flip(spark, d):
    c = trades(spark, d).groupBy("symbol", "reason").agg(F.sum("net").alias("x")).withColumn("k", F.concat("symbol", "reason"))
    return stats.sign_flip(c, "x", "k").select(F.round("p", 4).alias("p"))


@query(f"""WITH {TRADES}, r AS (SELECT exit AS day, sum(net) AS x FROM t GROUP BY 1), p AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, x FROM r), n AS (SELECT count(*) AS n FROM p), k AS (SELECT (n + 13) // 14 AS k FROM n),
dr AS (SELECT a.draw, b.j, ((a.draw * k + b.j) * 1103515245 + 7) % 2147483648 % n AS start FROM (SELECT unnest(range(0, 200)) AS draw) a, n, k, LATERAL (SELECT unnest(range(0, k.k)) AS j) b)
SELECT draw, round(sum(x) / ((SELECT k FROM k) * 14), 4) AS mean FROM dr, n, (SELECT unnest(range(0, 14)) AS o) o, p WHERE p.i = (dr.start + o.o) % n.n GROUP BY 1""")
def ml08_block_bootstrap(spark, d):
    r = trades(spark, d).groupBy(F.col("exit").alias("day")).agg(F.sum("net").alias("x"))
    return stats.block_bootstrap(r, "day", "x", 14, 200, 7).select("draw", F.round("mean", 4).alias("mean"))
