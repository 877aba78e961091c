"""Queries over aggregations of events, texts, runs and trades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import corpus, runs, selection, stats
from tidemark.plans.demo import BARS_1D, BARS_4H, RECORDS, SETTLEMENTS, TICKS, TRADES, bars_1d, bars_4h, event_records, settlements, ticks, trades
from tidemark.plans.market import OVER, W
from tidemark.plans.registry import query, rounded
from tidemark.sources.readers import table

IMPACT = ["t1", "t2", "t3"]


@query(f"""WITH {RECORDS} SELECT day, {", ".join(f"round(coalesce(avg(CASE WHEN event_type = '{t}' THEN CASE direction WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END * severity * surprise * confidence END), 0), 6) AS impact_{t}" for t in IMPACT)} FROM r GROUP BY 1""")
def ag02_conditional_impact(spark, d):
    """Mean signed impact of each event type of a day, 0 when it has none."""
    f = corpus.conditional_impact(event_records(spark, d), ["day"], IMPACT)
    return rounded(f, *(f"impact_{t}" for t in IMPACT))


@query(f"""WITH {RECORDS}, p AS (SELECT day, (doc_id % 7) / 10 AS up, (1 - (doc_id % 7) / 10) * (doc_id % 3) / 3 AS down FROM r), q AS (SELECT *, 1 - up - down AS flat FROM p)
SELECT day, round(avg(up), 6) AS up, round(avg(down), 6) AS down, round(avg(flat), 6) AS flat, round(avg(up - down), 6) AS tilt, round(avg(greatest(up, down, flat)), 6) AS sureness FROM q GROUP BY 1""")
def ag09_probabilities(spark, d):
    up = F.col("doc_id") % 7 / 10
    p = event_records(spark, d).select("day", up.alias("up"), ((1 - up) * (F.col("doc_id") % 3) / 3).alias("down")).withColumn("flat", 1 - F.col("up") - F.col("down"))
    a = p.groupBy("day").agg(*(F.avg(c).alias(c) for c in ("up", "down", "flat")), F.avg(F.col("up") - F.col("down")).alias("tilt"), F.avg(F.greatest("up", "down", "flat")).alias("sureness"))
    return rounded(a, "up", "down", "flat", "tilt", "sureness")


@query(f"""WITH {RECORDS}, p AS (SELECT event_type, CASE WHEN doc_id % 11 = 0 THEN 't0' ELSE event_type END AS other_type, assets, CASE WHEN doc_id % 13 = 0 THEN ['S0'] ELSE assets END AS other_assets, severity, CASE WHEN doc_id % 5 = 0 THEN confidence ELSE severity END AS other_severity FROM r)
SELECT count(*) AS n, sum((event_type = other_type)::INT)::BIGINT AS same_type, round(avg(len(list_intersect(assets, other_assets)) / len(list_distinct(list_concat(assets, other_assets)))), 6) AS overlap, round(avg(abs(severity - other_severity)), 6) AS distance FROM p""")
def ag14_field_agreement(spark, d):
    """Two extractions of the same items: equal types, mean overlap of the asset lists, mean absolute difference."""
    i, r = F.col("doc_id"), event_records(spark, d)
    other = r.select("doc_id", F.when(i % 11 == 0, "t0").otherwise(F.col("event_type")).alias("event_type"), F.when(i % 13 == 0, F.array(F.lit("S0"))).otherwise(F.col("assets")).alias("assets"), F.when(i % 5 == 0, F.col("confidence")).otherwise(F.col("severity")).alias("severity"))
    p = runs.paired(r.select("doc_id", "event_type", "assets", "severity"), other, "doc_id")
    return rounded(runs.field_agreement(p, "event_type", "assets", "severity"), "overlap", "distance")


@query(f"""WITH {TRADES}, c AS (SELECT year(DATE '1970-01-01' + entry::INTEGER)::BIGINT AS year, o_orderkey * 7 % 101 > 50 AS long, round(10000 * net / (qty * entry_price)) AS bps FROM t)
SELECT year, count(*) AS n, round(avg(bps), 4) AS mean, quantile_cont(bps, 0.5) AS median, round(avg((bps > 0)::INT), 6) AS positive, round(avg((long = (bps > 0))::INT), 6) AS accuracy, round(avg(CASE WHEN long THEN bps END) - avg(CASE WHEN NOT long THEN bps END), 4) AS difference FROM c GROUP BY ROLLUP (year)""")
def ag17_calibration(spark, d):
    """Results in whole basis points of trades called long or flat, by year and in all (null year). Medians hold one count for each value, so rounding bounds them."""
    t = trades(spark, d).select(F.year(F.date_from_unix_date(F.col("entry").cast("int"))).cast("long").alias("year"), (F.col("o_orderkey") * 7 % 101 > 50).alias("long"), F.round(10000 * F.col("net") / (F.col("qty") * F.col("entry_price"))).alias("bps"))
    x, up = F.col("bps"), F.col("bps") > 0
    a = t.rollup("year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.percentile("bps", 0.5).alias("median"), F.round(F.avg(up.cast("int")), 6).alias("positive"),
        F.round(F.avg((F.col("long") == up).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("long"), x)) - F.avg(F.when(~F.col("long"), x)), 4).alias("difference"),
    )
    return a.select("year", "n", "mean", "median", "positive", "accuracy", "difference")


@query(f"""WITH {BARS_1D}, r AS (SELECT symbol, close / lag(close) {OVER}) - 1 AS r FROM b) SELECT symbol, round(sum(ln(1 + r / 100)), 6) AS logs, round(exp(sum(ln(1 + r / 100))) - 1, 6) AS compounded FROM r WHERE r IS NOT NULL GROUP BY 1""")
def ag21_compounding(spark, d):
    r = bars_1d(spark, d).select("symbol", ((F.col("close") / F.lag("close").over(W()) - 1) / 100).alias("r")).where("r is not null")
    return rounded(r.groupBy("symbol").agg(F.sum(F.log1p("r")).alias("logs"), stats.compounded(F.col("r")).alias("compounded")), "logs", "compounded")


@query(f"""WITH {TRADES}, m AS (SELECT date_part('year', DATE '1970-01-01' + exit::INTEGER) * 12 + date_part('month', DATE '1970-01-01' + exit::INTEGER) - 1 AS month, net, reason FROM t)
SELECT month::BIGINT AS month, count(*) AS n, round(sum(net), 2) AS pnl, sum((reason = 'F')::INT)::BIGINT AS filled, sum((reason = 'O')::INT)::BIGINT AS open, round(sum(sum(net)) OVER (ORDER BY month), 2) AS balance FROM m GROUP BY m.month""")
def ag27_calendar(spark, d):
    """Trades by month (years times 12 plus months), exit kinds and the running balance; one row a month meets the window."""
    day = F.date_from_unix_date(F.col("exit").cast("int"))
    m = trades(spark, d).groupBy((F.year(day) * 12 + F.month(day) - 1).cast("long").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("net").alias("p"), F.count_if(F.col("reason") == "F").alias("filled"), F.count_if(F.col("reason") == "O").alias("open"))
    running = F.sum("p").over(Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return m.select("month", "n", F.round("p", 2).alias("pnl"), "filled", "open", F.round(running, 2).alias("balance"))


@query(f"""WITH {TRADES}, g AS (SELECT symbol, day + 1 AS entry, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS regime FROM b), k AS (SELECT t.*, coalesce(regime, 'unknown') AS regime, (t.entry - 8000) // 720 AS fold FROM t LEFT JOIN g USING (symbol, entry))
SELECT fold, regime, symbol, count(*) AS n, round(sum(net), 2) AS net, round(sum(fees), 2) AS fees, sum((reason = 'F')::INT)::BIGINT AS stops FROM k GROUP BY GROUPING SETS ((fold, regime), (fold, symbol), (regime, symbol))""")
def ag29_attribution(spark, d):
    """Results by fold and regime, fold and symbol, regime and symbol."""
    g = bars_1d(spark, d).select("symbol", (F.col("day") + 1).alias("entry"), F.when(F.col("close") >= F.col("open"), "up").otherwise("down").alias("regime"))
    k = trades(spark, d).join(g, ["symbol", "entry"], "left").withColumn("regime", F.coalesce("regime", F.lit("unknown"))).withColumn("fold", F.expr("(entry - 8000) div 720"))
    fold, regime, symbol = map(F.col, ("fold", "regime", "symbol"))
    a = k.groupingSets([(fold, regime), (fold, symbol), (regime, symbol)], fold, regime, symbol)
    return a.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net"), 2).alias("net"), F.round(F.sum("fees"), 2).alias("fees"), F.count_if(F.col("reason") == "F").alias("stops"))


@query(f"""WITH {TRADES}, p AS (SELECT symbol, reason, sum(net) AS v FROM t GROUP BY 1, 2) SELECT count(*) AS runs, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.5), 2) AS median, round(min(v), 2) AS least, round(max(v), 2) AS most, sum((v > 0)::INT)::BIGINT AS profitable FROM p""")
def ag31_cross_run(spark, d):
    """Summary over runs, of which there are few: one row per symbol and reason."""
    p = trades(spark, d).groupBy("symbol", "reason").agg(F.sum("net").alias("v"))
    a = p.agg(F.count(F.lit(1)).alias("runs"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v") > 0).alias("profitable"))
    return a.withColumns({c: F.round(c, 2) for c in ("mean", "median", "least", "most")})


@query(f"""WITH {TICKS} SELECT symbol, us // 14400000000 AS slot, round(least(greatest(sum(CASE WHEN side = 'buy' THEN 2 ELSE -2 END * least(price * qty / 500, 1)), -10), 10), 6) AS score, count(*) AS n FROM ticks WHERE price * qty >= 100 GROUP BY 1, 2""")
def ag33_large_transfers(spark, d):
    """Large transfers add up to two points each by their side; a slot's score stays within ten."""
    size = F.col("price") * F.col("qty")
    points = F.sum(F.when(F.col("side") == "buy", 2).otherwise(-2) * F.least(size / 500, F.lit(1.0)))
    a = ticks(spark, d).where(size >= 100).groupBy("symbol", F.expr("us div 14400000000").alias("slot")).agg(F.least(F.greatest(points, F.lit(-10.0)), F.lit(10.0)).alias("score"), F.count(F.lit(1)).alias("n"))
    return rounded(a, "score")


@query(f"""WITH {BARS_4H}, g AS (SELECT symbol, slot, close / open - 1 AS move, volume, (high - low) / open AS range FROM b4)
SELECT symbol, slot, round(least(greatest(0.35::DOUBLE * CASE WHEN move > 0.02 THEN 10 WHEN move > 0 THEN 4 WHEN move > -0.02 THEN -4 ELSE -10 END + 0.35::DOUBLE * CASE WHEN volume > 60 THEN 8 WHEN volume > 30 THEN 2 ELSE -3 END + 0.3::DOUBLE * CASE WHEN range > 0.5 THEN -6 ELSE 3 END, -8), 8), 6) AS score FROM g""")
def ag34_composite(spark, d):
    """A clamped mix of three scores by thresholds."""
    g = bars_4h(spark, d).select("symbol", "slot", (F.col("close") / F.col("open") - 1).alias("move"), "volume", ((F.col("high") - F.col("low")) / F.col("open")).alias("range"))
    parts = [(0.35, "move", [(0.02, 10), (0, 4), (-0.02, -4)], -10), (0.35, "volume", [(60, 8), (30, 2)], -3), (0.3, "range", [(0.5, -6)], 3)]
    return rounded(g.select("symbol", "slot", stats.composite(parts, 8.0).alias("score")), "score")


@query(f"""WITH {TRADES}, m AS (SELECT avg(net) AS m, count(*) AS n FROM t), c AS (SELECT symbol, entry // 30 AS month, sum(net - (SELECT m FROM m)) AS s FROM t GROUP BY 1, 2)
SELECT count(*) AS clusters, round(sqrt(sum(s * s)) / (SELECT n FROM m), 4) AS se, round(2.8::DOUBLE * sqrt(sum(s * s)) / (SELECT n FROM m), 4) AS mde FROM c""")
def ag35_cluster_error(spark, d):
    """Cluster-robust standard error of the mean and the effect it can detect."""
    e = stats.cluster_error(trades(spark, d).withColumn("month", F.expr("entry div 30")), ["symbol", "month"], "net")
    return e.select("clusters", F.round("se", 4).alias("se"), F.round("mde", 4).alias("mde"))


@query("SELECT source, count(*) AS n, round(tanh((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) / sqrt(count(*) - 3)), 6) AS mde FROM documents GROUP BY 1 HAVING count(*) > 3")
def ag36_correlation_mde(spark, d):
    return rounded(stats.correlation_mde(table(spark, d, "documents"), ["source"]), "mde")


@query("""WITH x AS (SELECT vec_id % 50 AS bucket, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings), p AS (SELECT bucket, dim, avg(v) AS m, max(v) AS top FROM x GROUP BY 1, 2)
SELECT bucket, dim, round(m / nullif(sqrt(sum(m * m) OVER (PARTITION BY bucket)), 0), 6) AS mean, round(top, 6) AS top FROM p""")
def ag37_pooling(spark, d):
    """Per bucket and dimension the mean, scaled to length one over the bucket, and the largest value."""
    e = table(spark, d, "embeddings").withColumn("bucket", F.col("vec_id") % 50)
    return rounded(stats.pooled(e, "bucket", "embedding"), "mean", "top")


@query(f"""WITH {RECORDS} SELECT day, round(avg(severity - surprise), 6) AS mean, round(max(severity - surprise), 6) AS most, round(min(severity - surprise), 6) AS least, round(stddev_pop(severity - surprise), 6) AS deviation, round(avg(abs(severity - surprise)), 6) AS size FROM r GROUP BY 1""")
def ag38_score_statistics(spark, d):
    x = F.col("severity") - F.col("surprise")
    a = event_records(spark, d).groupBy("day").agg(F.avg(x).alias("mean"), F.max(x).alias("most"), F.min(x).alias("least"), F.stddev_pop(x).alias("deviation"), F.avg(F.abs(x)).alias("size"))
    return rounded(a, "mean", "most", "least", "deviation", "size")


@query(f"WITH {SETTLEMENTS} SELECT symbol, sec // 86400 AS day, round(sum(rate), 6) AS rate, count(*) AS n FROM s GROUP BY 1, 2")
def ag39_settlement_days(spark, d):
    return rounded(settlements(spark, d).groupBy("symbol", F.expr("sec div 86400").alias("day")).agg(F.sum("rate").alias("rate"), F.count(F.lit(1)).alias("n")), "rate")


@query("SELECT doc_id // 4 AS release, count(*) AS n, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS sha FROM documents GROUP BY 1")
def ag41_same_time_merge(spark, d):
    """Documents of one release (four at most) as one text with its digest."""
    return corpus.merged(table(spark, d, "documents").withColumn("release", F.expr("doc_id div 4")), "release", "text", "doc_id").select("release", "n", "sha")


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), u AS (SELECT doc_id, chunk, min(pos) AS pos FROM x GROUP BY 1, 2)
SELECT doc_id, count(*) AS chunks, sha256(string_agg(chunk, chr(10) ORDER BY pos)) AS sha FROM u GROUP BY 1""")
def ag42_assembly(spark, d):
    """An article from its chunks: each once, in the order of its first place."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "chunk"))
    return corpus.assembled(x, "doc_id", "pos", "chunk").select("doc_id", "chunks", F.sha2("text", 256).alias("sha"))


@query(f"""WITH {BARS_1D}, r AS (SELECT symbol, day, close / lag(close) {OVER}) - 1 AS r FROM b), p AS (SELECT x.r AS a, y.r AS c FROM r x JOIN r y USING (day) WHERE x.symbol = 'S0' AND y.symbol = 'S1' AND x.r IS NOT NULL AND y.r IS NOT NULL),
m AS (SELECT count(*) AS n, avg(a) AS ma, avg(c) AS mc, stddev_samp(a) AS sa, stddev_samp(c) AS sc, covar_samp(a, c) AS k, avg(a - c) AS md, stddev_samp(a - c) AS sd FROM p)
SELECT n, round((sc * ma - sa * mc) / sqrt((2 * sa ** 2 * sc ** 2 - 2 * sa * sc * k + ma ** 2 * sc ** 2 / 2 + mc ** 2 * sa ** 2 / 2 - ma * mc * k ** 2 / (sa * sc)) / n), 6) AS sharpe_z, round(md / (sd / sqrt(n)), 6) AS mean_t, round(md / sd * sqrt(365), 6) AS information FROM m""")
def ag44_difference_tests(spark, d):
    """Difference of two Sharpe ratios, of two means, and the information ratio, from one pass of moments."""
    r = bars_1d(spark, d).select("symbol", "day", (F.col("close") / F.lag("close").over(W()) - 1).alias("r")).where("r is not null")
    pair = r.where("symbol = 'S0'").select("day", F.col("r").alias("a")).join(r.where("symbol = 'S1'").select("day", F.col("r").alias("c")), "day")
    return rounded(stats.difference_tests(pair, "a", "c", 365), "sharpe_z", "mean_t", "information")


@query(f"""WITH {RECORDS}, x AS (SELECT unnest(assets) AS symbol, (day - 19723) // 7 AS fold, day, status FROM r)
SELECT symbol, fold, count(*) AS records, count(DISTINCT day) AS days, round(avg((status = 'error')::INT), 6) AS failed, count(DISTINCT day) >= 5 AND avg((status = 'error')::INT) <= 0.02 AS passed FROM x GROUP BY 1, 2""")
def ag45_coverage(spark, d):
    """Records, days and share of failures of each asset and fold against their thresholds."""
    x = event_records(spark, d).select(F.explode("assets").alias("symbol"), F.expr("(day - 19723) div 7").alias("fold"), "day", (F.col("status") == "error").cast("int").alias("e"))
    a = x.groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("day").alias("days"), F.avg("e").alias("failed"))
    return a.withColumn("passed", (F.col("days") >= 5) & (F.col("failed") <= 0.02)).withColumn("failed", F.round("failed", 6))


@query(r"""WITH k AS (SELECT source, regexp_matches(lower(text), '\b(up|rise|good|new)\b') AS l, regexp_matches(lower(text), '\b(down|fall|bad|old)\b') AS s FROM documents)
SELECT source, CASE WHEN l AND s THEN 'both' WHEN l THEN 'long' WHEN s THEN 'short' ELSE 'ambiguous' END AS side, count(*) AS n FROM k GROUP BY 1, 2""")
def ag46_lexical_sides(spark, d):
    low = F.lower("text")
    long, short = low.rlike(r"\b(up|rise|good|new)\b"), low.rlike(r"\b(down|fall|bad|old)\b")
    side = F.when(long & short, "both").when(long, "long").when(short, "short").otherwise("ambiguous")
    return table(spark, d, "documents").groupBy("source", side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BARS_4H}, g AS (SELECT slot, close / open - 1 AS r FROM b4) SELECT slot, CASE WHEN count(*) >= 3 THEN round(avg(r), 6) END AS mean, CASE WHEN count(*) >= 3 THEN round(avg((r > 0)::INT), 6) END AS rising, CASE WHEN count(*) >= 3 THEN round(stddev_pop(r), 6) END AS spread FROM g GROUP BY 1""")
def ag47_breadth(spark, d):
    """Mean move, share of risers and spread over the symbols of a slot, null for fewer than three."""
    r, enough = F.col("close") / F.col("open") - 1, F.count(F.lit(1)) >= 3
    a = bars_4h(spark, d).groupBy("slot").agg(F.when(enough, F.avg(r)).alias("mean"), F.when(enough, F.avg((r > 0).cast("int"))).alias("rising"), F.when(enough, F.stddev_pop(r)).alias("spread"))
    return rounded(a, "mean", "rising", "spread")


@query(f"""WITH {RECORDS}, a AS (SELECT count(*) AS n, avg((status = 'error')::INT) AS e, count(DISTINCT day) AS days, avg(confidence) AS c FROM r), g AS (SELECT unnest([struct_pack(check_name := 'rows', passed := n >= 100), struct_pack(check_name := 'errors', passed := e <= 0.02), struct_pack(check_name := 'days', passed := days >= 25), struct_pack(check_name := 'confidence', passed := c >= 0.9)]) AS g FROM a)
SELECT g.check_name AS check_name, g.passed AS passed, bool_and(g.passed) OVER () AS all_passed FROM g""")
def ag48_gates(spark, d):
    """Named checks over one row of aggregates, and whether all hold."""
    a = event_records(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("status") == "error").cast("int")).alias("e"), F.countDistinct("day").alias("days"), F.avg("confidence").alias("c"))
    return stats.gates(a, {"rows": F.col("n") >= 100, "errors": F.col("e") <= 0.02, "days": F.col("days") >= 25, "confidence": F.col("c") >= 0.9})


@query(f"""WITH {BARS_1D}, m AS (SELECT symbol, day, round(close / lag(close, 20) {OVER}) - 1, 9) AS m FROM b) SELECT day, symbol, rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY m DESC, symbol) AS rank FROM m WHERE m > 0) WHERE rank <= 2""")
def tk02_11_momentum(spark, d):
    """The two entrants with the best positive 20-day return of each day, ties by symbol (TK-02, TK-11)."""
    m = bars_1d(spark, d).select("symbol", "day", F.round(F.col("close") / F.lag("close", 20).over(W()) - 1, 9).alias("m")).where("m > 0")
    return selection.top_n(m, ["day"], [F.desc("m"), F.asc("symbol")], 2).select("day", "symbol", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {TRADES}, f AS (SELECT symbol || reason AS config, (entry - 8000) // 360 AS fold, sum(net) AS v FROM t GROUP BY 1, 2), c AS (SELECT config, sum(v) AS total, sum((v > 0)::INT) AS good, min(v) AS worst FROM f WHERE fold < 5 GROUP BY 1)
SELECT config, round(total, 2) AS total FROM c WHERE good >= 2 AND worst > -1e9::DOUBLE ORDER BY total DESC, config LIMIT 1""")
def tk08_best_configuration(spark, d):
    """The configuration of the largest training result among those that pass the gates."""
    f = trades(spark, d).groupBy(F.concat("symbol", "reason").alias("config"), F.expr("(entry - 8000) div 360").alias("fold")).agg(F.sum("net").alias("v")).where("fold < 5")
    best = selection.best_configuration(f, "config", "v", F.col("good") >= 2, F.col("worst") > -1e9)
    return best.select("config", F.round("total", 2).alias("total"))


@query(f"""WITH {RECORDS}, k AS (SELECT doc_id, day, row_number() OVER (PARTITION BY day ORDER BY severity DESC, doc_id) AS a, count(*) FILTER (WHERE doc_id % 10 = 0) OVER (PARTITION BY day) AS zeros, count(*) FILTER (WHERE doc_id % 10 = 1) OVER (PARTITION BY day) AS halves FROM r)
SELECT doc_id, CASE WHEN a <= zeros THEN 0 WHEN a <= zeros + halves THEN 0.5::DOUBLE ELSE 1 END AS weight FROM k""")
def tk10_same_density(spark, d):
    """As many rows get weight 0 and 0.5 as another rule gave, by the ranking of severity within the day."""
    r, i = event_records(spark, d), F.col("doc_id") % 10
    return selection.same_density(r, "day", -F.col("severity"), "doc_id", i == 0, i == 1).select("doc_id", "weight")


@query(f"""WITH {BARS_1D}, {BARS_4H} SELECT 'day' AS run, symbol, count(*) AS n, round(max(high), 6) AS high FROM b GROUP BY 2 UNION ALL SELECT 'slot', symbol, count(*), round(max(high), 6) FROM b4 GROUP BY 2""")
def st06_stacked_runs(spark, d):
    one = lambda b, name: b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("high")).withColumn("run", F.lit(name))
    return rounded(one(bars_1d(spark, d), "day").unionByName(one(bars_4h(spark, d), "slot")).select("run", "symbol", "n", "high"), "high")


@query(f"""WITH {RECORDS}, x AS (SELECT day, domain, published, event_type, unnest(assets) AS a FROM r) SELECT day, domain, min(published) AS first, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, array_to_string(list_sort(list(DISTINCT a)), ',') AS assets FROM x GROUP BY 1, 2""")
def st07_merged_lists(spark, d):
    """Records of a day and domain as one: earliest time, union of types and of assets; the sets hold enumerated values, so they stay small."""
    x = event_records(spark, d).select("day", "domain", "published", "event_type", F.explode("assets").alias("a"))
    union = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return x.groupBy("day", "domain").agg(F.min("published").alias("first"), union("event_type").alias("types"), union("a").alias("assets"))
