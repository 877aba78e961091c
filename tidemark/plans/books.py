"""Queries over positions, arms, valuation of trades and text-driven schedules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import books, corpus, selection, timeline
from tidemark.operators import indicators as I
from tidemark.plans.demo import BARS_1D, BARS_4H, RECORDS, SETTLEMENTS, TRADES, bars_1d, bars_4h, event_records, settlements, trades
from tidemark.plans.market import OVER, W, rows
from tidemark.plans.registry import query, rounded

W4 = "OVER (PARTITION BY symbol ORDER BY slot"


@query(f"""WITH {SETTLEMENTS}, {BARS_4H[BARS_4H.index("b4 AS") :]}, q AS (SELECT symbol, sec // 14400 AS slot, sum(rate) AS rate FROM s GROUP BY 1, 2),
g AS (SELECT symbol, slot, round(close / open - 1, 9) AS a, round(close / ((high + low) / 2) - 1, 9) AS c, lead(open, 2) {W4}) / lead(open, 1) {W4}) - 1 AS move, lead(slot) {W4}) AS held FROM b4),
k AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY a DESC, symbol) + row_number() OVER (PARTITION BY slot ORDER BY c DESC, symbol) AS ranks FROM g WHERE move IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY ranks, symbol) <= ceil(count(*) OVER (PARTITION BY slot) / 3) AS chosen FROM k)
SELECT z.slot, round(avg(z.move - coalesce(q.rate, 0)), 6) AS net FROM z LEFT JOIN q ON q.symbol = z.symbol AND q.slot = z.held WHERE chosen GROUP BY 1""")
def pf03_basis_factor(spark, d):
    """The third of symbols best by the sum of two ranks, from the next open to the one after, less the funding of the bar held."""
    w = Window.partitionBy("symbol").orderBy("slot")
    g = bars_4h(spark, d).select(
        "symbol", "slot", F.round(F.col("close") / F.col("open") - 1, 9).alias("a"), F.round(F.col("close") / ((F.col("high") + F.col("low")) / 2) - 1, 9).alias("c"),
        (F.lead("open", 2).over(w) / F.lead("open", 1).over(w) - 1).alias("move"), F.lead("slot").over(w).alias("held"),
    ).where("move is not null")
    q = settlements(spark, d).groupBy("symbol", F.expr("sec div 14400").alias("held")).agg(F.sum("rate").alias("rate"))
    chosen = selection.rank_sum(g, ["slot"], ["a", "c"], "symbol").where("chosen").join(q, ["symbol", "held"], "left")
    return rounded(chosen.groupBy("slot").agg(F.avg(F.col("move") - F.coalesce("rate", F.lit(0.0))).alias("net")), "net")


@query(f"""WITH {SETTLEMENTS}, f AS (SELECT symbol, sec // 86400 AS day, sum(round(rate * 1e6)::BIGINT)::BIGINT AS rate FROM s GROUP BY 1, 2), g AS (SELECT *, (sum(rate) {OVER} RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING))::BIGINT AS past FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY past DESC, symbol) AS i FROM g WHERE past > 10000) SELECT day, count(*) AS held, sum(rate - 400)::BIGINT::DOUBLE / 2e6::DOUBLE AS carry FROM k WHERE i <= 2 GROUP BY 1""")
def pf04_funding_carry(spark, d):
    """The two symbols that paid most over the three days before, above a threshold, less the cost of both legs. Rates are whole millionths and are added as such, as a half of one is exact only then."""
    millionths = F.round(F.col("rate") * 1e6).cast("long")
    f = settlements(spark, d).groupBy("symbol", F.expr("sec div 86400").alias("day")).agg(F.sum(millionths).alias("rate"))
    g = f.withColumn("past", F.sum("rate").over(W().rangeBetween(-3, -1))).where("past > 10000")
    k = g.withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("past"), "symbol"))).where("i <= 2")
    return k.groupBy("day").agg(F.count(F.lit(1)).alias("held"), (F.sum(F.col("rate") - 400).cast("double") / 2e6).alias("carry"))


ARM = f"a AS (SELECT symbol, day, arm, CASE arm WHEN 'half' THEN 0.5::DOUBLE * p ELSE p END AS w, r FROM (SELECT symbol, day, (CASE WHEN close > open THEN 1 ELSE 0 END)::DOUBLE AS p, lead(close) {OVER}) / close - 1 AS r FROM b), (SELECT unnest(['full', 'half']) AS arm) WHERE r IS NOT NULL)"


@query(f"""WITH {BARS_1D}, {ARM}, x AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY arm, symbol ORDER BY day), 0)) AS t FROM a)
SELECT arm, day, round(sum(w * r), 6) AS gross, round(sum(t), 6) AS turnover, round(0.001::DOUBLE * sum(t), 6) AS cost, round(sum(w * r) - 0.001::DOUBLE * sum(t), 6) AS net FROM x GROUP BY 1, 2""")
def pf07_arm_returns(spark, d):
    """Gross, turnover, cost and net by arm and day."""
    b = bars_1d(spark, d).select("symbol", "day", (F.col("close") > F.col("open")).cast("double").alias("p"), (F.lead("close").over(W()) / F.col("close") - 1).alias("r")).where("r is not null")
    arms = F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), (F.col("p") * s).alias("w")) for n, s in (("full", 1.0), ("half", 0.5)))))
    x = b.select("symbol", "day", "r", arms.alias("g")).select("symbol", "day", "r", "g.arm", "g.w")
    return rounded(books.arm_returns(x, "arm", "symbol", "day", "w", "r", 0.001), "gross", "turnover", "cost", "net")


@query(f"""WITH {BARS_1D}, p AS (SELECT symbol, day, CASE WHEN close >= open THEN 1 ELSE -1 END AS side, lead(close) {OVER}) / close - 1 AS r FROM b), q AS (SELECT *, lag(side) {OVER}) AS before, lead(day) {OVER}) IS NULL AS last FROM p WHERE r IS NOT NULL)
SELECT symbol, day, round(side * r - side * 0.0001::DOUBLE - 0.001::DOUBLE * abs(side - coalesce(before, 0)) - CASE WHEN last THEN 0.001::DOUBLE ELSE 0 END, 6) AS net FROM q""")
def pf08_sign_position(spark, d):
    """Long or short by the sign of a forecast: funding, cost of each change, and of the exit on the last row."""
    p = bars_1d(spark, d).select("symbol", "day", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1).alias("side"), (F.lead("close").over(W()) / F.col("close") - 1).alias("r")).where("r is not null")
    return rounded(books.signed_returns(p, "symbol", "day", "side", "r", F.lit(0.0001), 0.001).select("symbol", "day", "net"), "net")


@query(f"""WITH {TRADES}, k AS (SELECT symbol, net / 1e5::DOUBLE AS r, o_orderkey * 7 % 101 >= 50 AS up, row_number() OVER (PARTITION BY symbol ORDER BY sha256('b:' || o_orderkey::VARCHAR), o_orderkey) <= count(*) FILTER (WHERE o_orderkey * 7 % 101 >= 50) OVER (PARTITION BY symbol) AS placebo, avg((o_orderkey * 7 % 101 >= 50)::INT) OVER (PARTITION BY symbol) AS share FROM t)
SELECT symbol, round(avg(r), 6) AS base, round(avg(r * CASE WHEN up THEN 1.25::DOUBLE ELSE 1 END), 6) AS raised, round(avg(r * (1 + 0.25::DOUBLE * share)), 6) AS matched, round(avg(r * CASE WHEN placebo THEN 1.25::DOUBLE ELSE 1 END), 6) AS shuffled FROM k GROUP BY 1""")
def pf10_reallocation(spark, d):
    """A quarter more exposure where a score is high, against the same budget spread evenly and dealt by hash."""
    t = trades(spark, d).withColumn("r", F.col("net") / 1e5).withColumn("up", F.col("o_orderkey") * 7 % 101 >= 50)
    return rounded(books.reallocated(t, "symbol", "o_orderkey", "r", "up", 0.25, "b:"), "base", "raised", "matched", "shuffled")


HALF = """a AS (SELECT o_orderkey, symbol, qty, entry + 1 AS day, exit FROM t WHERE exit > entry + 2)"""


@query(f"""WITH {TRADES}, {HALF} SELECT o_orderkey, round(0.5::DOUBLE * qty * (x.open * (1 - 0.0005::DOUBLE) - y.open * (1 + 0.0005::DOUBLE)), 2) AS price, round(0.0005::DOUBLE * qty * (x.open + y.open), 2) AS fees, round(0.5::DOUBLE * qty * x.open * 0.0001::DOUBLE, 2) AS funding
FROM a JOIN b x ON x.symbol = a.symbol AND x.day = a.day JOIN b y ON y.symbol = a.symbol AND y.day = a.day + 1""")
def pf11_half_for_a_bar(spark, d):
    """Half of a position sold at one open and bought back at the next: price with slippage, fees, funding saved."""
    a = trades(spark, d).where(F.col("exit") > F.col("entry") + 2).select("o_orderkey", "symbol", "qty", (F.col("entry") + 1).alias("day"))
    h = books.half_for_a_bar(a, bars_1d(spark, d), "symbol", "day", "qty", 0.0005, 0.001, 0.0001)
    return h.select("o_orderkey", *(F.round(c, 2).alias(c) for c in ("price", "fees", "funding")))


HALF_OF_ALL = """a AS (SELECT o_orderkey, symbol, qty, entry + 1 AS day, exit FROM t WHERE exit > entry + 2)"""


@query(f"""WITH {TRADES}, {HALF_OF_ALL} SELECT o_orderkey, round(0.5::DOUBLE * qty * (x.open * (1 - 0.0005::DOUBLE) - y.open * (1 + 0.0005::DOUBLE)), 2) AS price, round(0.0005::DOUBLE * qty * (x.open + y.open), 2) AS fees, round(0.5::DOUBLE * qty * x.open * 0.0001::DOUBLE, 2) AS funding
FROM a JOIN b x ON x.symbol = a.symbol AND x.day = a.day JOIN b y ON y.symbol = a.symbol AND y.day = a.day + 1""")
def pf11_half_of_all(spark, d):
    """The same for every trade that lasts long enough."""
    a = trades(spark, d).where(F.col("exit") > F.col("entry") + 2).select("o_orderkey", "symbol", "qty", (F.col("entry") + 1).alias("day"))
    h = books.half_for_a_bar(a, bars_1d(spark, d), "symbol", "day", "qty", 0.0005, 0.001, 0.0001)
    return h.select("o_orderkey", *(F.round(c, 2).alias(c) for c in ("price", "fees", "funding")))


@query(f"""WITH {BARS_1D}, x AS (SELECT symbol, day, volume % 7 < 1 AS warned, lead(close) {OVER}) / close - 1 AS r FROM b), g AS (SELECT *, max(warned::INT) {OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS low FROM x WHERE r IS NOT NULL),
k AS (SELECT *, CASE WHEN low THEN 0.25::DOUBLE ELSE 0.5 END AS e, coalesce(lag(low) {OVER}), false) AS before FROM g)
SELECT symbol, round(sum(0.5::DOUBLE * r), 6) AS base, round(sum(e * r - 0.001::DOUBLE * CASE WHEN low <> before THEN 0.25::DOUBLE ELSE 0 END), 6) AS attenuated, round(min(0.5::DOUBLE * r), 6) AS base_worst, round(min(e * r), 6) AS worst FROM k GROUP BY 1""")
def pf12_attenuated(spark, d):
    """Half the exposure for three bars from a warning, with the cost of each change, and what the worst bar gains."""
    x = bars_1d(spark, d).select("symbol", "day", (F.col("volume") % 7 < 1).alias("warned"), (F.lead("close").over(W()) / F.col("close") - 1).alias("r")).where("r is not null")
    return rounded(books.attenuated(x, "symbol", "day", "warned", "r", 3, 0.5, 0.25, 0.001), "base", "attenuated", "base_worst", "worst")


@query(f"""WITH {RECORDS}, {BARS_1D}, s AS (SELECT day, avg(CASE direction WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END * severity) AS score, avg(confidence) AS confidence FROM r GROUP BY 1), sp AS (SELECT unnest(range((SELECT min(day) FROM s), (SELECT max(day) FROM s) + 1)) AS day)
SELECT day * 86400 + 14400 AS at, (coalesce(score, 0) >= 0.01 AND coalesce(confidence, 0) >= 0.7)::BIGINT AS target FROM sp LEFT JOIN s USING (day)""")
def pf13_news_schedule(spark, d):
    """Long from four hours after a day whose texts score and are sure enough; days without texts are flat."""
    sign = F.when(F.col("direction") == 1, 1).when(F.col("direction") == 2, -1).otherwise(0)
    s = event_records(spark, d).groupBy("day").agg(F.avg(sign * F.col("severity")).alias("score"), F.avg("confidence").alias("confidence"))
    long = (F.col("score") >= 0.01) & (F.col("confidence") >= 0.7)
    return corpus.on_spine(s, "day").select((F.col("day") * 86400 + 14400).alias("at"), long.cast("long").alias("target"))


@query(f"""WITH {TRADES}, f AS (SELECT symbol, day, sum((high - low) / open) / 1e4::DOUBLE AS rate FROM b GROUP BY 1, 2), q AS (SELECT t.o_orderkey, coalesce(sum(f.rate), 0) AS rate FROM t LEFT JOIN f ON f.symbol = t.symbol AND f.day > t.entry AND f.day < t.exit GROUP BY 1)
SELECT o_orderkey, round(gross, 2) AS gross, round(0.0005::DOUBLE * qty * (entry_price + exit_price), 2) AS slippage, round(fees, 2) AS fees, round(rate * qty * entry_price, 2) AS funding, round(gross - 0.0005::DOUBLE * qty * (entry_price + exit_price) - fees - rate * qty * entry_price, 2) AS net FROM t JOIN q USING (o_orderkey)""")
def pf14_valuation(spark, d):
    """Trades valued with slippage, fees and the funding of the days strictly between entry and exit."""
    rates = bars_1d(spark, d).select("symbol", "day", ((F.col("high") - F.col("low")) / F.col("open") / 1e4).alias("rate"))
    v = books.value_trades(trades(spark, d), rates, "o_orderkey", "symbol", 0.0005)
    return v.select("o_orderkey", *(F.round(c, 2).alias(c) for c in ("gross", "slippage", "fees", "funding", "net")))


@query(f"""WITH {BARS_4H}, {RECORDS}, v AS (SELECT published AS sec, avg(CASE direction WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END * severity) AS score FROM r GROUP BY 1), g AS (SELECT symbol, slot, slot * 14400 AS sec, CASE WHEN close >= open THEN 1 ELSE -1 END AS signal FROM b4)
SELECT symbol, slot, CASE WHEN score IS NULL THEN 'wait' WHEN signal * score < -0.3 THEN 'veto' WHEN signal = 1 THEN 'long' ELSE 'short' END AS decision FROM g ASOF LEFT JOIN v ON g.sec >= v.sec""")
def pf17_guard(spark, d):
    """A signal is vetoed when the latest score opposes it; without a score it waits."""
    sign = F.when(F.col("direction") == 1, 1).when(F.col("direction") == 2, -1).otherwise(0)
    scores = event_records(spark, d).groupBy(F.col("published").alias("sec")).agg(F.avg(sign * F.col("severity")).alias("score")).withColumn("all", F.lit(1))
    slots = bars_4h(spark, d).withColumn("sec", F.col("slot") * 14400)
    known = timeline.asof_join(slots.select("sec").distinct().withColumn("all", F.lit(1)), scores, "all", "sec", ["score"]).select("sec", "score")
    signal = F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)
    g = slots.join(known, "sec").withColumn("signal", signal)
    decision = F.when(F.col("score").isNull(), "wait").when(F.col("signal") * F.col("score") < -0.3, "veto").when(F.col("signal") == 1, "long").otherwise("short")
    return g.select("symbol", "slot", decision.alias("decision"))


@query(f"""WITH {TRADES}, r AS (SELECT *, avg(high - low) {rows(14)} AS range14, count(*) {rows(14)} AS n FROM b)
SELECT o_orderkey, r.day, r.day - t.entry AS age, round(r.close / entry_price - 1, 6) AS ret, round((r.close - 0.5::DOUBLE * entry_price) / range14, 6) AS to_stop FROM t JOIN r ON r.symbol = t.symbol AND r.day > t.entry AND r.day < t.exit WHERE n = 14 AND range14 > 0""")
def wn36_path_features(spark, d):
    """Age, return so far and distance to the stop in mean ranges on every day of a trade (also JN-09)."""
    r = bars_1d(spark, d).select("symbol", "day", "close", I.full(W(), 14, F.avg(F.col("high") - F.col("low")).over(I.last_rows(W(), 14))).alias("range14"))
    days = trades(spark, d).where(F.col("exit") - F.col("entry") >= 2).withColumn("day", F.explode(F.sequence(F.col("entry") + 1, F.col("exit") - 1)))
    x = days.join(r, ["symbol", "day"]).where("range14 > 0")
    ret, stop = F.col("close") / F.col("entry_price") - 1, (F.col("close") - 0.5 * F.col("entry_price")) / F.col("range14")
    return rounded(x.select("o_orderkey", "day", (F.col("day") - F.col("entry")).alias("age"), ret.alias("ret"), stop.alias("to_stop")), "ret", "to_stop")


@query(f"""WITH {RECORDS}, k AS (SELECT doc_id, event_type, confidence, published, unnest(range(published // 14400 + 1, published // 14400 + 19)) AS slot FROM r), w AS (SELECT slot, event_type, sum(confidence * (1 - (slot * 14400 - published) / 259200)) AS w, count(*) AS n FROM k WHERE slot * 14400 - published < 259200 GROUP BY 1, 2),
g AS (SELECT slot, round(sum(w), 6) AS weight, sum(n)::BIGINT AS items FROM w GROUP BY 1) SELECT slot, weight, items, event_type AS dominant FROM g JOIN (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY round(w, 9) DESC, event_type DESC) AS i FROM w) USING (slot) WHERE i = 1""")
def wn45_decayed_state(spark, d):
    """Weight of the texts of the last 72 hours at each decision, fading with age, and the type with the most of it."""
    return rounded(books.decayed_state(event_records(spark, d), "event_type", "confidence", "published", 14400, 18), "weight")


@query(f"""WITH {BARS_1D}, g AS (SELECT symbol, day, close, avg(high - low) {rows(14)} AS a, count(*) {rows(14)} AS n FROM b) SELECT symbol, day, round(close - least(2 * a, 0.1::DOUBLE * close), 6) AS stop, round(close + least(3 * a, 0.2::DOUBLE * close), 6) AS target, round(1000 / least(2 * a, 0.1::DOUBLE * close), 6) AS size FROM g WHERE n = 14 AND a > 0""")
def wn46_risk_levels(spark, d):
    """Stop and target by mean range within percentage caps, and the size that risks a fixed amount."""
    g = bars_1d(spark, d).withColumn("a", I.full(W(), 14, F.avg(F.col("high") - F.col("low")).over(I.last_rows(W(), 14)))).where("a > 0")
    return rounded(books.risk_levels(g, "close", "a", (2.0, 0.1), (3.0, 0.2), 1000.0).select("symbol", "day", "stop", "target", "size"), "stop", "target", "size")


@query(f"""WITH {BARS_1D}, r AS (SELECT *, greatest(high - low, abs(high - lag(close) {OVER})), abs(low - lag(close) {OVER}))) AS tr FROM b),
g AS (SELECT *, avg(tr) {rows(14)} AS atr, count(*) {rows(14)} AS n, lag(high, 2) {OVER}) AS lh, lag(open) {OVER}) AS po, lag(close) {OVER}) AS pc, lag(high) {OVER}) AS ph, lag(low) {OVER}) AS pl FROM r),
k AS (SELECT symbol, day, close, CASE WHEN n = 14 AND low - lh >= 0.15::DOUBLE * atr THEN (low + lh) / 2 END AS gm, CASE WHEN n = 14 AND pc < po AND close > open AND close - open >= atr THEN (ph + pl) / 2 END AS bm FROM g),
f AS (SELECT symbol, day, close, last_value(gm IGNORE NULLS) {OVER}) AS gm, last_value(bm IGNORE NULLS) {OVER}) AS bm FROM k)
SELECT symbol, day, CASE WHEN abs(gm / close - 1) <= 0.05 THEN 'gap' WHEN abs(bm / close - 1) <= 0.05 THEN 'block' ELSE 'market' END AS kind, round(CASE WHEN abs(gm / close - 1) <= 0.05 THEN gm WHEN abs(bm / close - 1) <= 0.05 THEN bm ELSE close END, 6) AS entry FROM f""")
def wn42_precision_entry(spark, d):
    """Entry at the latest gap, else the latest order block, if within five percent, else at the market."""
    g = I.price_patterns(bars_1d(spark, d), "symbol", "day", 14, 0.15, 1.0)
    last = lambda c: F.last(c, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0))
    f = g.withColumn("gm", last("gap_middle")).withColumn("bm", last("block_middle"))
    near = lambda c: F.abs(F.col(c) / F.col("close") - 1) <= 0.05
    kind = F.when(near("gm"), "gap").when(near("bm"), "block").otherwise("market")
    return rounded(f.select("symbol", "day", kind.alias("kind"), F.when(near("gm"), F.col("gm")).when(near("bm"), F.col("bm")).otherwise(F.col("close")).alias("entry")), "entry")
