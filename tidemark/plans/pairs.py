"""Queries over joins in time and on keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import timeline
from tidemark.plans.demo import BARS_1D, BARS_4H, NEWS, RECORDS, RUNS, SETTLEMENTS, TRADES, bars_1d, bars_4h, event_records, news, run, settlements, trades
from tidemark.plans.market import OVER, W
from tidemark.plans.registry import query, rounded
from tidemark.sources.readers import table


@query("""WITH k AS (SELECT doc_id, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS n FROM documents d)
SELECT count(*) FILTER (WHERE n = 0) AS left_only, (SELECT count(DISTINCT doc_id) FROM labels ANTI JOIN documents USING (doc_id)) AS right_only, count(*) FILTER (WHERE n > 1) AS twice FROM k""")
def jn01_coverage(spark, d):
    """The proof that a one-to-one join covers both sides: keys missing on either, keys held twice."""
    return timeline.one_to_one(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")[1]


@query(f"""WITH {SETTLEMENTS}, q AS (SELECT symbol, slot * 14400 AS sec FROM (SELECT DISTINCT symbol, us // 14400000000 AS slot FROM ticks)), v AS (SELECT symbol, sec, max(rate) AS rate FROM s GROUP BY 1, 2),
a AS (SELECT q.symbol, q.sec, v.rate AS now FROM q ASOF LEFT JOIN v ON q.symbol = v.symbol AND q.sec >= v.sec), c AS (SELECT a.*, v.rate AS before FROM a ASOF LEFT JOIN v ON a.symbol = v.symbol AND a.sec - 604800 >= v.sec)
SELECT symbol, sec, coalesce(now > before, false) AS rising FROM c""")
def jn05_change_gate(spark, d):
    """Is the latest known rate above the one known a week earlier? False where either is missing."""
    s = settlements(spark, d).groupBy("symbol", "sec").agg(F.max("rate").alias("rate"))
    q = bars_4h(spark, d).select("symbol", (F.col("slot") * 14400).alias("sec"))
    now = timeline.asof_join(q, s, "symbol", "sec", ["rate"]).withColumnRenamed("rate", "now")
    earlier = now.withColumn("asked", F.col("sec")).withColumn("sec", F.col("sec") - 604800)
    both = timeline.asof_join(earlier, s, "symbol", "sec", ["rate"])
    return both.select("symbol", F.col("asked").alias("sec"), F.coalesce(F.col("now") > F.col("rate"), F.lit(False)).alias("rising"))


@query(f"""WITH {NEWS}, {BARS_4H}, k AS (SELECT DISTINCT slot FROM b4) SELECT (published // 14400 + (published % 14400 > 0)::BIGINT) AS slot, count(*) AS n, min(doc_id) AS first_id FROM n WHERE (published // 14400 + (published % 14400 > 0)::BIGINT) IN (SELECT slot FROM k) GROUP BY 1""")
def jn10_texts_of_decision(spark, d):
    """Texts available in the four hours up to and including a decision, by the boundary at or after them."""
    n = news(spark, d).withColumn("slot", (timeline.next_boundary(F.col("published"), 14400, False) / 14400).cast("long"))
    decided = bars_4h(spark, d).select("slot").distinct()
    return n.join(decided, "slot", "left_semi").groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""WITH {BARS_1D}, m AS (SELECT symbol, day FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY turnover DESC, symbol) AS i FROM b) WHERE i <= 2) SELECT symbol, day, round(close, 6) AS close FROM b SEMI JOIN m USING (symbol, day)""")
def jn11_members(spark, d):
    """Bars of the symbols selected for their day."""
    b = bars_1d(spark, d)
    i = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("turnover"), "symbol"))
    chosen = b.withColumn("i", i).where("i <= 2").select("symbol", "day")
    return rounded(b.join(chosen, ["symbol", "day"], "left_semi").select("symbol", "day", "close"), "close")


@query(f"""WITH {BARS_1D}, r AS (SELECT symbol, day, round(close / lag(close) {OVER}) - 1, 9) AS x, round(volume, 9) AS y, round(lead(open, 2) {OVER}) / lead(open, 1) {OVER}) - 1, 9) AS outcome, lead(day, 2) {OVER}) AS known FROM b),
k AS (SELECT * FROM r WHERE x IS NOT NULL AND outcome IS NOT NULL), p AS (SELECT q.symbol, q.day, c.outcome, row_number() OVER (PARTITION BY q.symbol, q.day ORDER BY round(abs(q.x - c.x) + abs(q.y - c.y) / 1000, 9), c.day) AS i
FROM r q JOIN k c ON q.symbol = c.symbol AND c.known <= q.day AND c.day >= q.day - 30 WHERE q.x IS NOT NULL) SELECT symbol, day, count(*) AS n, round(avg(outcome), 6) AS expected FROM p WHERE i <= 3 GROUP BY 1, 2""")
def jn13_known_cases(spark, d):
    """The three nearest cases of the last 30 days whose outcome was known, and their mean outcome."""
    b = bars_1d(spark, d).select(
        "symbol", "day", F.round(F.col("close") / F.lag("close").over(W()) - 1, 9).alias("x"), F.round("volume", 9).alias("y"),
        F.round(F.lead("open", 2).over(W()) / F.lead("open", 1).over(W()) - 1, 9).alias("outcome"), F.lead("day", 2).over(W()).alias("known"),
    )
    near = timeline.known_cases(b.where("x is not null"), b.where("x is not null and outcome is not null"), "symbol", "day", "known", {"x": 1.0, "y": 1000.0}, 30, 3)
    return rounded(near.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.avg("outcome").alias("expected")), "expected")


@query(f"""WITH {BARS_1D}, x AS (SELECT day, close AS a FROM b WHERE symbol = 'S0'), y AS (SELECT day, close AS c FROM b WHERE symbol = 'S1'), u AS (SELECT day, a, c FROM x FULL JOIN y USING (day)),
f AS (SELECT day, last_value(a IGNORE NULLS) OVER (ORDER BY day) AS a, last_value(c IGNORE NULLS) OVER (ORDER BY day) AS c FROM u) SELECT day, round(0.6::DOUBLE * a + 0.4::DOUBLE * c, 6) AS blend FROM f WHERE a IS NOT NULL AND c IS NOT NULL""")
def jn15_blend(spark, d):
    """Two series on the union of their days, each carried forward, weighted."""
    b = bars_1d(spark, d)
    one = b.where("symbol = 'S0'").select("day", F.col("close").alias("v"))
    two = b.where("symbol = 'S1'").select("day", F.col("close").alias("v"))
    return rounded(timeline.blend([(one, 0.6), (two, 0.4)], "day", "v"), "blend")


@query(f"WITH {BARS_1D} SELECT x.day, round(x.close / y.close - 1, 6) AS basis FROM b x JOIN b y USING (day) WHERE x.symbol = 'S0' AND y.symbol = 'S1'")
def jn16_ratio(spark, d):
    b = bars_1d(spark, d)
    two = b.where("symbol = 'S1'").select("day", F.col("close").alias("base"))
    return rounded(b.where("symbol = 'S0'").join(two, "day").select("day", (F.col("close") / F.col("base") - 1).alias("basis")), "basis")


@query(f"WITH {RUNS} SELECT doc_id, round(b.score - a.score, 6) AS difference FROM ra a JOIN rb b USING (doc_id)")
def jn18_paired_contrast(spark, d):
    """Second run less the first by row."""
    one = run(spark, d).select("doc_id", F.col("score").alias("before"))
    return rounded(run(spark, d, True).join(one, "doc_id").select("doc_id", (F.col("score") - F.col("before")).alias("difference")), "difference")


@query(f"""WITH {NEWS}, s AS (SELECT event_id, epoch_us(ts) // 1000000 AS sec FROM events), p AS (SELECT doc_id, event_id, abs(sec - published) AS distance FROM n JOIN s ON abs(sec - published) <= 3600),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, event_id) AS i FROM p) SELECT doc_id, event_id, distance FROM q WHERE i = 1""")
def jn19_nearest_within(spark, d):
    """The capture closest to each publication, at most an hour away; ties to the smaller id."""
    captures = table(spark, d, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("sec"))
    return timeline.nearest_within(news(spark, d).select("doc_id", "published"), captures, "doc_id", "published", "event_id", "sec", 3600)


@query(f"""WITH {NEWS}, s AS (SELECT epoch_us(ts) // 1000000 AS sec, min(event_id) AS event_id FROM events GROUP BY 1), a AS (SELECT n.doc_id, n.published, s.event_id, n.published - s.sec AS distance FROM n ASOF JOIN s ON n.published >= s.sec),
c AS (SELECT n.doc_id, n.published, s.event_id, s.sec - n.published AS distance FROM n ASOF JOIN s ON n.published <= s.sec), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, event_id) AS i FROM (FROM a UNION ALL FROM c) WHERE distance <= 86400)
SELECT doc_id, event_id, distance FROM q WHERE i = 1""")
def jn19_nearest_capture(spark, d):
    """The capture, among all events, closest to each publication, at most a day away; ties to the smaller id."""
    captures = table(spark, d, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("sec"))
    return timeline.nearest_within(news(spark, d).select("doc_id", "published"), captures, "doc_id", "published", "event_id", "sec", 86_400)


@query(f"""WITH {TRADES}, g AS (SELECT symbol, day + 1 AS entry, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS regime FROM b) SELECT o_orderkey, coalesce(regime, 'unknown') AS regime FROM t LEFT JOIN g USING (symbol, entry)""")
def jn20_lagged_regime(spark, d):
    """The regime of the day before a trade's entry."""
    g = bars_1d(spark, d).select("symbol", (F.col("day") + 1).alias("entry"), F.when(F.col("close") >= F.col("open"), "up").otherwise("down").alias("regime"))
    return trades(spark, d).join(g, ["symbol", "entry"], "left").select("o_orderkey", F.coalesce("regime", F.lit("unknown")).alias("regime"))


WEIGHTS = {"t1": 1.0, "t2": 0.5, "t3": 0.25}


@query(f"""WITH {RECORDS}, w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}) v(event_type, weight)) SELECT doc_id, round(severity * coalesce(weight, 0), 6) AS weighted FROM r LEFT JOIN w USING (event_type)""")
def jn22_weight_map(spark, d):
    """Severity by the weight of its type; types without a weight count nothing."""
    known = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    return rounded(event_records(spark, d).select("doc_id", (F.col("severity") * F.coalesce(F.element_at(known, F.col("event_type")), F.lit(0.0))).alias("weighted")), "weighted")


@query(f"""WITH {NEWS}, {BARS_4H}, g AS (SELECT symbol, slot, lead(close) OVER (PARTITION BY symbol ORDER BY slot) > close AS up FROM b4) SELECT doc_id, symbol, up::BIGINT AS label FROM n JOIN g ON published // 14400 = slot WHERE up IS NOT NULL""")
def jn23_news_labels(spark, d):
    """Texts with the direction of each symbol's close after the bar that they fall in."""
    w = Window.partitionBy("symbol").orderBy("slot")
    g = bars_4h(spark, d).select("symbol", "slot", (F.lead("close").over(w) > F.col("close")).cast("long").alias("label")).where("label is not null")
    return news(spark, d).select("doc_id", F.expr("published div 14400").alias("slot")).join(g, "slot").select("doc_id", "symbol", "label")


@query(f"""WITH {RUNS}, p AS (SELECT doc_id, a.score <> b.score AS s, a.action <> b.action AS c FROM ra a JOIN rb b USING (doc_id)) SELECT doc_id, CASE WHEN s AND c THEN 'score,action' WHEN s THEN 'score' ELSE 'action' END AS fields FROM p WHERE s OR c""")
def jn24_parity(spark, d):
    """Rows on which two engines differ, with the fields."""
    return timeline.differing(run(spark, d), run(spark, d, True), "doc_id", ["score", "action", "confidence"])
