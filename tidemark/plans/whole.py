"""Queries over texts, ledgers and trials that give all the fields of their operator."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tidemark.operators import books, corpus, ledgers, models, paths, stats, trials
from tidemark.plans.demo import BARS_1D, BARS_4H, NEWS, RECORDS, TRADES, bars_1d, bars_4h, event_records, news, trades
from tidemark.plans.market import OVER, W
from tidemark.plans.registry import query, rounded
from tidemark.plans.texts import TITLE
from tidemark.plans.trials import DESIGN, RETURNS, design, run_returns
from tidemark.sources.readers import table, written

SIGN = "CASE direction WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END"


def sign():
    return F.when(F.col("direction") == 1, 1).when(F.col("direction") == 2, -1).otherwise(0)


@query(f"""WITH {NEWS} SELECT doc_id, CASE WHEN date_only THEN published // 86400 * 86400 + 86400 ELSE published END AS available, CASE WHEN date_only THEN 'date' ELSE 'second' END AS precision FROM n""")
def prj02_available_with_precision(spark, d):
    """When a publication becomes available, and how precisely its source said so."""
    n = news(spark, d)
    return n.select("doc_id", corpus.available(F.col("published"), F.col("date_only")).alias("available"), F.when(F.col("date_only"), "date").otherwise("second").alias("precision"))


ADMIT = f"""k AS (SELECT *, {TITLE} AS title, regexp_replace(url, '/+$', '') AS link, CASE WHEN coalesce({TITLE}, '') = '' THEN 'missing_title' WHEN domain NOT IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') THEN 'host' WHEN published % 86400 < 3600 THEN 'timestamp' END AS reason FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY published, doc_id) AS i FROM k WHERE reason IS NULL), u AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY published, doc_id) AS j FROM t WHERE i = 1),
z AS (SELECT doc_id, reason FROM k WHERE reason IS NOT NULL UNION ALL SELECT doc_id, 'duplicate_title' FROM t WHERE i > 1 UNION ALL SELECT doc_id, CASE WHEN j > 1 THEN 'duplicate_url' END FROM u)"""


@query(f"WITH {NEWS}, {ADMIT} SELECT doc_id, coalesce(reason, 'accepted') AS reason FROM z")
def prj03_admission_with_duplicates(spark, d):
    """The first rule that each publication fails: title, host, time, then a title seen before, then a link seen before among those left."""
    n = news(spark, d)
    rules = [("missing_title", corpus.normal_title("headline") != ""), ("host", F.col("domain").isin(*(f"src{i}" for i in range(1, 7)))), ("timestamp", F.col("published") % 86400 >= 3600)]
    n = n.select("doc_id", "published", F.sha2(corpus.normal_title("headline"), 256).alias("title"), F.regexp_replace("url", "/+$", "").alias("link"), corpus.first_reason(rules).alias("reason"))
    out = corpus.admitted(n, "reason", [("duplicate_title", "title"), ("duplicate_url", "link")], ["published", "doc_id"])
    return out.select("doc_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


ALIASES = {"s0": "S0", "s1": "S1", "alpha": "S1", "s2": "S2", "beta": "S2"}


@query(f"""WITH {RECORDS}, x AS (SELECT doc_id, lower(unnest(assets || CASE WHEN doc_id % 7 = 0 THEN ['Alpha', 'BETA'] ELSE [] END)) AS alias FROM r), m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items())}) v(alias, symbol))
SELECT doc_id, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM x JOIN m USING (alias) GROUP BY 1""")
def prj09_alias_map(spark, d):
    """The symbols that a record's assets stand for, by any of their aliases in any case; records without one are left out."""
    r = event_records(spark, d).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("assets", F.array(F.lit("Alpha"), F.lit("BETA")))).otherwise(F.col("assets")).alias("assets"))
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    symbols = F.array_sort(F.array_distinct(F.array_compact(F.transform("assets", lambda a: F.element_at(known, F.lower(a))))))
    return r.select("doc_id", F.array_join(symbols, ",").alias("symbols")).where("symbols <> ''")


CONTRACT = """SELECT doc_id, reason FROM (SELECT doc_id, CASE WHEN fill <= decided THEN 'fill' WHEN NOT symbol LIKE 'S%' THEN 'symbol' WHEN length(snapshot) <> 64 OR length(pipeline) <> 64 THEN 'hash' WHEN arm = 'technical' AND score IS NOT NULL THEN 'arm' END AS reason
FROM (SELECT doc_id, published AS decided, published + CASE WHEN doc_id % 41 = 0 THEN 0 ELSE 60 END AS fill, CASE WHEN doc_id % 43 = 0 THEN 'X1' ELSE 'S1' END AS symbol, sha256(url) AS snapshot, CASE WHEN doc_id % 47 = 0 THEN md5(url) ELSE sha256(domain) END AS pipeline,
  CASE WHEN doc_id % 2 = 0 THEN 'technical' ELSE 'both' END AS arm, CASE WHEN doc_id % 2 = 1 OR doc_id % 38 = 0 THEN n_chars END AS score FROM n)) WHERE reason IS NOT NULL"""


@query(f"WITH {NEWS} {CONTRACT}")
def prj15_whole_contract(spark, d):
    """Decisions that break their contract: fill after the decision, known symbol, full hashes, no text score in the technical arm."""
    i, n = F.col("doc_id"), news(spark, d)
    x = n.select(
        "doc_id", F.col("published").alias("decided"), (F.col("published") + F.when(i % 41 == 0, 0).otherwise(60)).alias("fill"), F.when(i % 43 == 0, "X1").otherwise("S1").alias("symbol"), F.sha2("url", 256).alias("snapshot"),
        F.when(i % 47 == 0, F.md5("url")).otherwise(F.sha2("domain", 256)).alias("pipeline"), F.when(i % 2 == 0, "technical").otherwise("both").alias("arm"), F.when((i % 2 == 1) | (i % 38 == 0), F.col("n_chars")).alias("score"),
    )
    rules = [
        ("fill", F.col("fill") > F.col("decided")), ("symbol", F.col("symbol").startswith("S")), ("hash", (F.length("snapshot") == 64) & (F.length("pipeline") == 64)), ("arm", (F.col("arm") != "technical") | F.col("score").isNull()),
    ]
    return x.select("doc_id", corpus.first_reason(rules).alias("reason")).where("reason is not null")


SCOPE = {0: 1.0, 1: 0.5, 2: 0.0}


@query(f"""WITH {RECORDS} SELECT day, {", ".join(f"round(coalesce(avg(CASE WHEN event_type = '{t}' THEN {SIGN} * severity * surprise * confidence * CASE doc_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0 END END), 0), 6) AS impact_{t}" for t in ("t1", "t2", "t3"))} FROM r GROUP BY 1""")
def ag02_weighted_impact(spark, d):
    """Mean signed impact of each event type, weighted by scope."""
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in SCOPE.items() for x in pair)), (F.col("doc_id") % 3).cast("int"))
    f = corpus.conditional_impact(event_records(spark, d), ["day"], ["t1", "t2", "t3"], weight)
    return rounded(f, "impact_t1", "impact_t2", "impact_t3")


LEVELS = (20, 50, 100, 200, 500)


@query(rf"""WITH {NEWS}, f AS (SELECT n.*, text, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS w, {TITLE} AS title, lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS body, regexp_replace(url, '/+$', '') AS link FROM n JOIN documents USING (doc_id)),
b AS (SELECT published // 14400 AS bucket, count(*) AS n, count(DISTINCT domain) AS sources FROM f GROUP BY 1), s AS (SELECT domain, count(*) AS n FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25)
SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM f UNION ALL SELECT 'valid_times', count(published) FROM f UNION ALL SELECT 'ids', count(DISTINCT doc_id) FROM f UNION ALL SELECT 'urls', count(DISTINCT link) FROM f UNION ALL SELECT 'titles', count(DISTINCT title) FILTER (WHERE title <> '') FROM f
UNION ALL SELECT 'bodies', count(DISTINCT body) FILTER (WHERE body <> '') FROM f UNION ALL SELECT 'sources', count(DISTINCT domain) FROM f UNION ALL SELECT 'first', min(published) FROM f UNION ALL SELECT 'last', max(published) FROM f
UNION ALL SELECT 'year:' || year(make_timestamp(published * 1000000)), count(*) FROM f GROUP BY 1 {"".join(f"UNION ALL SELECT 'words_p{q}', quantile_cont(w, {q / 100}) FROM f " for q in (10, 25, 50, 75, 90))}
{"".join(f"UNION ALL SELECT 'words_at_least_{k}', count(*) FILTER (WHERE w >= {k}) FROM f " for k in LEVELS)} UNION ALL SELECT 'buckets', count(*) FROM b UNION ALL SELECT 'multi_source_buckets', count(*) FILTER (WHERE sources >= 2) FROM b
UNION ALL SELECT 'bucket_p50', quantile_cont(n, 0.5) FROM b UNION ALL SELECT 'bucket_p90', quantile_cont(n, 0.9) FROM b UNION ALL SELECT 'bucket_max', max(n) FROM b UNION ALL SELECT 'source:' || domain, n FROM s""")
def ag07_full_profile(spark, d):
    """Everything that describes a corpus, one metric a row."""
    text = table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"))).alias("words"), corpus.normal_title("text").alias("body"))
    n = news(spark, d).select("doc_id", "published", corpus.normal_title("headline").alias("title"), F.regexp_replace("url", "/+$", "").alias("link"), "domain").join(text, "doc_id")
    return corpus.full_profile(n, "doc_id", "published", "title", "link", "domain", "body", "words", LEVELS, 14_400, 25)


@query(f"""WITH c AS (SELECT conv_id, text, min(turn) AS first, count(DISTINCT role) AS roles FROM conversations GROUP BY 1, 2), g AS (SELECT conv_id, count(*) AS chunks, string_agg(text, chr(10) ORDER BY first, text) AS text FROM c GROUP BY 1),
q AS (SELECT conv_id, count(DISTINCT role) AS roles, count(DISTINCT conv_id % 7) AS dates FROM conversations GROUP BY 1) SELECT conv_id, chunks, sha256(text) AS sha, dates = 1 AS one_date, roles = 1 AS one_label FROM g JOIN q USING (conv_id)""")
def ag42_checked_assembly(spark, d):
    """Texts from their distinct chunks in order, with whether each had one date and one label."""
    c = table(spark, d, "conversations").withColumn("date", F.col("conv_id") % 7)
    out = corpus.assembled(c.where("text is not null"), "conv_id", "turn", "text").withColumn("sha", F.sha2("text", 256))
    one = corpus.one_each(c, "conv_id", {"one_date": "date", "one_label": "role"})
    return out.join(one, "conv_id").select("conv_id", "chunks", "sha", "one_date", "one_label")


@query(f"""WITH {RECORDS}, i AS (SELECT doc_id, domain, published AS t0, CASE direction WHEN 1 THEN 'supportive' WHEN 2 THEN 'adverse' ELSE 'none' END AS pressure, confidence * CASE doc_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0 END AS base, 'm' || (doc_id % 4) AS mechanism,
  event_type AS stage, 't' || (doc_id % 31) AS signature FROM r), k AS (SELECT *, unnest(range(CEIL(t0 / 14400)::BIGINT, CEIL(t0 / 14400)::BIGINT + 18)) AS slot FROM i),
a AS (SELECT *, (slot * 14400 - t0) / 3600 AS age FROM k WHERE slot * 14400 - t0 < 259200), m AS (SELECT *, base * (CASE WHEN age < 4 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN age < 12 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN age < 24 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN age < 72 THEN 0.1::DOUBLE ELSE 0 END) AS w FROM a),
s AS (SELECT slot, count(*) AS items, count(DISTINCT domain) AS sources, sum((base > 0)::INT)::BIGINT AS applicable, sum((pressure = 'adverse' AND w > 0)::INT)::BIGINT AS adverse_items, sum((pressure = 'supportive' AND w > 0)::INT)::BIGINT AS supportive_items,
  round(sum(CASE WHEN pressure = 'adverse' THEN w ELSE 0 END), 6) AS adverse, round(sum(CASE WHEN pressure = 'supportive' THEN w ELSE 0 END), 6) AS supportive, bool_or(age < 4) AS fresh FROM m GROUP BY 1),
st AS (SELECT slot, stage, row_number() OVER (PARTITION BY slot ORDER BY round(sum(w), 9) DESC, stage DESC) AS i FROM m WHERE pressure <> 'none' AND w > 0 GROUP BY 1, 2), me AS (SELECT slot, mechanism, row_number() OVER (PARTITION BY slot ORDER BY round(sum(w), 9) DESC, mechanism DESC) AS i FROM m WHERE pressure <> 'none' AND w > 0 GROUP BY 1, 2),
nv AS (SELECT slot, count(*) AS novel FROM (SELECT slot, signature FROM m GROUP BY 1, 2 HAVING bool_and(age = 0)) GROUP BY 1)
SELECT slot, items, sources, applicable, adverse_items, supportive_items, adverse, supportive, coalesce(stage, 'unknown') AS stage, coalesce(mechanism, 'unknown') AS mechanism, coalesce(novel, 0) AS novel, fresh
FROM s LEFT JOIN (SELECT slot, stage FROM st WHERE i = 1) USING (slot) LEFT JOIN (SELECT slot, mechanism FROM me WHERE i = 1) USING (slot) LEFT JOIN nv USING (slot)""")
def wn45_text_state(spark, d):
    """What the texts of the last 72 hours say at each decision: masses by horizon and scope, sources, stage and mechanism with the most of it, and signatures not seen before."""
    i = F.col("doc_id")
    scope = F.element_at(F.create_map(*(F.lit(x) for pair in SCOPE.items() for x in pair)), (i % 3).cast("int"))
    items = event_records(spark, d).select(
        "doc_id", "domain", F.col("published").alias("at"), F.when(F.col("direction") == 1, "supportive").when(F.col("direction") == 2, "adverse").otherwise("none").alias("pressure"), (F.col("confidence") * scope).alias("base"),
        F.concat(F.lit("m"), i % 4).alias("mechanism"), F.col("event_type").alias("stage"), F.concat(F.lit("t"), i % 31).alias("signature"),
    )
    return rounded(books.text_state(items, 14_400, [(4, 0.4), (12, 0.3), (24, 0.2), (72, 0.1)]), "adverse", "supportive")


# Ledgers


COSTS = "0.0005::DOUBLE * qty * (entry_price + exit_price)"
FUNDED = f"""f AS (SELECT symbol, day, (high - low) / open / 1e4::DOUBLE AS rate FROM b), q AS (SELECT t.o_orderkey, coalesce(sum(f.rate), 0) AS rate FROM t LEFT JOIN f ON f.symbol = t.symbol AND f.day > t.entry AND f.day < t.exit GROUP BY 1),
v AS (SELECT t.o_orderkey, symbol, reason, gross, {COSTS} AS execution, fees, rate * qty * entry_price AS funding FROM t JOIN q USING (o_orderkey)), c AS (SELECT *, gross - execution - fees - funding AS net FROM v),
p AS (SELECT o_orderkey, round(gross, 2) AS gross, round(execution, 2) AS execution, round(CASE WHEN o_orderkey % 97 = 0 THEN fees + 1 ELSE fees END, 2) AS fees, round(funding, 2) AS funding, round(CASE WHEN o_orderkey % 89 = 0 THEN net - 5 ELSE net END, 2) AS net FROM c)"""
PARTS = ("gross", "execution", "fees", "funding", "net")


def recomputed(spark, d):
    rates = bars_1d(spark, d).select("symbol", "day", ((F.col("high") - F.col("low")) / F.col("open") / 1e4).alias("rate"))
    return books.value_trades(trades(spark, d), rates, "o_orderkey", "symbol", 0.0005).select("o_orderkey", "symbol", "reason", "gross", F.col("slippage").alias("execution"), "fees", "funding", "net")


def reported(spark, d):
    """A statement in whole cents, with fees and results that are wrong on known trades."""
    v, i = recomputed(spark, d), F.col("o_orderkey")
    wrong = {"fees": F.when(i % 97 == 0, F.col("fees") + 1).otherwise(F.col("fees")), "net": F.when(i % 89 == 0, F.col("net") - 5).otherwise(F.col("net"))}
    return v.select("o_orderkey", *(F.round(wrong.get(c, F.col(c)), 2).alias(c) for c in PARTS))


@query(f"""WITH {TRADES}, {FUNDED} SELECT c.o_orderkey, array_to_string(list_filter([{", ".join(f"CASE WHEN abs(c.{x} - p.{x}) > 0.006::DOUBLE THEN '{x}' END" for x in PARTS)}], lambda x: x IS NOT NULL), ',') AS parts,
  round(greatest({", ".join(f"abs(c.{x} - p.{x})" for x in PARTS)}), 1) AS error FROM c JOIN p USING (o_orderkey) WHERE greatest({", ".join(f"abs(c.{x} - p.{x})" for x in PARTS)}) > 0.006::DOUBLE""")
def pf15_reconciliation(spark, d):
    """Trades whose reported components differ from those computed again from bars and rates, by more than half a cent."""
    out = ledgers.reconcile(recomputed(spark, d), reported(spark, d), "o_orderkey", list(PARTS), 0.006)
    return out.select("o_orderkey", "parts", F.round("error", 1).alias("error"))


@query(f"""WITH {TRADES}, {FUNDED} SELECT symbol, reason, count(*) AS n, {", ".join(f"round(sum(c.{x}), 2) AS {x}" for x in PARTS)}, round(max(abs(p.gross - p.execution - p.fees - p.funding - p.net)), 1) AS error FROM c JOIN p USING (o_orderkey) GROUP BY GROUPING SETS ((symbol, reason), (symbol), (reason), ())""")
def ag26_full_decomposition(spark, d):
    """Gross, execution cost, fees, funding and net by symbol, by reason and in all, and the largest gap between a trade's reported parts and its reported result."""
    rep = reported(spark, d)
    gap = rep.select("o_orderkey", F.abs(F.col("gross") - F.col("execution") - F.col("fees") - F.col("funding") - F.col("net")).alias("gap"))
    v = recomputed(spark, d).join(gap, "o_orderkey")
    out = v.groupingSets([["symbol", "reason"], ["symbol"], ["reason"], []], "symbol", "reason").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.sum(x), 2).alias(x) for x in PARTS), F.round(F.max("gap"), 1).alias("error"))
    return out


@query(f"""WITH {TRADES}, q AS (SELECT symbol, exit AS day, sum(net) / 1e9::DOUBLE AS r FROM t GROUP BY 1, 2), e AS (SELECT *, sum(ln(1 + r)) {OVER}) AS l FROM q), g AS (SELECT *, 1 - exp(l - greatest(max(l) {OVER}), 0)) AS dd FROM e),
a AS (SELECT symbol, exp(sum(ln(1 + r))) AS growth, max(day) - min(day) + 1 AS days, max(dd) AS dd FROM g GROUP BY 1) SELECT symbol, round(growth ** (365.0::DOUBLE / days) - 1, 6) AS cagr, round(dd, 6) AS drawdown, round(CASE WHEN dd > 0 THEN (growth ** (365.0::DOUBLE / days) - 1) / dd END, 6) AS calmar FROM a""")
def ag23_growth(spark, d):
    """Annual growth, largest drawdown and their ratio."""
    q = trades(spark, d).groupBy("symbol", F.col("exit").alias("day")).agg((F.sum("net") / 1e9).alias("r"))
    return rounded(ledgers.growth(q, "symbol", "day", "r", 365.0), "cagr", "drawdown", "calmar")


@query(f"""WITH {BARS_1D}, x AS (SELECT symbol, day, (CASE WHEN close > open THEN 1 ELSE 0 END)::DOUBLE AS p, lead(close) {OVER}) / close - 1 AS r FROM b), a AS (SELECT symbol, day, arm, CASE arm WHEN 'half' THEN 0.1::DOUBLE * p ELSE 0.2::DOUBLE * p END AS w, r FROM x, (SELECT unnest(['full', 'half']) AS arm) WHERE r IS NOT NULL),
y AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY arm, symbol ORDER BY day), 0)) AS t FROM a), n AS (SELECT arm, day, sum(w * r) / 10 - 0.0001::DOUBLE * sum(t) AS net, sum(t) AS t FROM y GROUP BY 1, 2),
l AS (SELECT *, sum(ln(1 + net)) OVER (PARTITION BY arm ORDER BY day) AS l FROM n), g AS (SELECT *, 1 - exp(l - greatest(max(l) OVER (PARTITION BY arm ORDER BY day), 0)) AS dd FROM l)
SELECT arm, count(*) AS days, round(exp(sum(ln(1 + net))) - 1, 6) AS total, round(exp(sum(ln(1 + net)) * 365 / count(*)) - 1, 6) AS annual, round(avg(net), 8) AS mean, round(max(dd), 6) AS drawdown, round(sum(t), 4) AS turnover FROM g GROUP BY 1""")
def pf07_arm_summary(spark, d):
    """What each arm made in all and a year, its drawdown and turnover."""
    b = bars_1d(spark, d).select("symbol", "day", (F.col("close") > F.col("open")).cast("double").alias("p"), ((F.lead("close").over(W()) / F.col("close") - 1) / 10).alias("r")).where("r is not null")
    arms = F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), (F.col("p") * s).alias("w")) for n, s in (("full", 0.2), ("half", 0.1)))))
    x = b.select("symbol", "day", "r", arms.alias("g")).select("symbol", "day", "r", "g.arm", "g.w")
    s = ledgers.summary(books.arm_returns(x, "arm", "symbol", "day", "w", "r", 0.0001), "arm", "day", "net", "turnover", 365.0)
    return rounded(s, "total", "annual", "drawdown").withColumn("mean", F.round("mean", 8)).withColumn("turnover", F.round("turnover", 4))


@query(f"""WITH {RECORDS}, s AS (SELECT day, avg({SIGN} * severity) AS score, avg(confidence) AS confidence FROM r GROUP BY 1), m AS (SELECT DISTINCT day, 'S' || ((day + o) % 5) AS symbol FROM s, (SELECT unnest([0, 1]) AS o)), sp AS (SELECT unnest(range((SELECT min(day) FROM s), (SELECT max(day) FROM s) + 1)) AS day),
x AS (SELECT 'S' || unnest(range(5)) AS symbol) SELECT symbol, day * 86400 + 14400 AS at, (coalesce(score, 0) >= 0.01 AND coalesce(confidence, 0) >= 0.7 AND m.day IS NOT NULL)::BIGINT AS target FROM sp CROSS JOIN x LEFT JOIN s USING (day) LEFT JOIN m USING (day, symbol)""")
def pf13_news_schedule_of_members(spark, d):
    """Targets of each symbol four hours after a day: long when the day's texts score and are sure enough and the symbol is a member that day."""
    s = event_records(spark, d).groupBy("day").agg(F.avg(sign() * F.col("severity")).alias("score"), F.avg("confidence").alias("confidence"))
    members = s.select("day", F.explode(F.array(*(F.concat(F.lit("S"), (F.col("day") + o) % 5) for o in (0, 1)))).alias("symbol")).distinct().withColumn("member", F.lit(True))
    days = corpus.on_spine(s, "day").withColumn("symbol", F.explode(F.array(*(F.lit(f"S{i}") for i in range(5)))))
    long = (F.col("score") >= 0.01) & (F.col("confidence") >= 0.7) & F.coalesce("member", F.lit(False))
    return days.join(members, ["day", "symbol"], "left").select("symbol", (F.col("day") * 86400 + 14400).alias("at"), long.cast("long").alias("target"))


@query(f"""WITH {BARS_4H}, k AS (SELECT symbol, slot, i, close * (1 - 0.0005::DOUBLE * i) AS bp, volume / (i + 1.0::DOUBLE) AS bs, close * (1 + 0.0004::DOUBLE * i) AS ap, volume / (2 * i + 1.0::DOUBLE) AS sz FROM b4, (SELECT unnest([1, 2, 3]) AS i)),
g AS (SELECT symbol, slot, sum(bp * bs) AS bid, sum(ap * sz) AS ask, max(bp) AS best_bid, min(ap) AS best_ask FROM k GROUP BY 1, 2), f AS (SELECT symbol, us // 14400000000 AS slot, sum(CASE WHEN side = 'buy' THEN price * qty ELSE 0 END) AS bought, sum(CASE WHEN side = 'sell' THEN price * qty ELSE 0 END) AS sold FROM ticks GROUP BY 1, 2)
SELECT symbol, slot, (best_bid + best_ask) / 2 AS mid, round((best_ask / best_bid - 1) * 10000, 6) AS spread_bps, round(bid, 9) AS bid_depth, round(ask, 9) AS ask_depth, round((bid - ask) / (bid + ask), 6) AS book_imbalance, round(bought, 6) AS bought, round(sold, 6) AS sold, round((bought - sold) / (bought + sold), 6) AS flow_imbalance
FROM g JOIN f USING (symbol, slot) WHERE bid + ask > 0 AND bought + sold > 0 AND best_bid > 0""")
def ag32_book_and_flow(spark, d):
    """Depth, middle and spread of an order book of levels, and the notional bought and sold beside it."""
    from tidemark.plans.demo import ticks

    level = lambda step, size: F.array(*(F.struct((F.col("close") * (1 + step * i)).alias("price"), (F.col("volume") / size(i)).alias("size")) for i in (1, 2, 3)))
    book = bars_4h(spark, d).select("symbol", "slot", level(-0.0005, lambda i: i + 1.0).alias("bids"), level(0.0004, lambda i: 2 * i + 1.0).alias("asks"))
    v = F.col("price") * F.col("qty")
    flow = ticks(spark, d).groupBy("symbol", F.expr("us div 14400000000").alias("slot")).agg(*(F.sum(F.when(F.col("side") == s, v).otherwise(0.0)).alias(n) for s, n in (("buy", "bought"), ("sell", "sold"))))
    x = ledgers.book_measures(book, "bids", "asks").join(flow, ["symbol", "slot"]).withColumn("flow_imbalance", F.try_divide(F.col("bought") - F.col("sold"), F.col("bought") + F.col("sold"))).where("book_imbalance is not null and flow_imbalance is not null and spread_bps is not null")
    names = ["mid", "spread_bps", "bid_depth", "ask_depth", "book_imbalance", "bought", "sold", "flow_imbalance"]
    deep = {c: F.round(c, 9) for c in ("bid_depth", "ask_depth")}  # six places would cut at halves; the middle is one double on both sides
    return rounded(x.select("symbol", "slot", *names).withColumns(deep), *(c for c in names[1:] if c not in deep))


# Models and trials


@query(f"""WITH {BARS_1D}, {DESIGN}, k AS (SELECT *, n * (c1 * (n + 10) - n * r * c2) / ((n + 10) ** 2 - (n * r) ** 2) AS b1, n * (c2 * (n + 10) - n * r * c1) / ((n + 10) ** 2 - (n * r) ** 2) AS b2 FROM m),
e AS (SELECT fold, avg((y - my) ** 2) AS prior, avg((y - my - n * c2 / (n + 10) * (x2 - m2) / s2) ** 2) AS metadata, avg((y - my - n * c1 / (n + 10) * (x1 - m1) / s1) ** 2) AS generic, avg((y - my - b1 * (x1 - m1) / s1 - b2 * (x2 - m2) / s2) ** 2) AS event FROM f JOIN k USING (fold) WHERE role = 'valid' GROUP BY 1),
a AS (SELECT fold, prior, unnest(['prior', 'metadata', 'generic', 'event']) AS arm, unnest([prior, metadata, generic, event]) AS mse FROM e) SELECT arm, round(avg(mse), 6) AS mse, round(avg(mse - prior), 6) AS delta, sum((mse < prior)::INT)::BIGINT AS wins, count(*) AS folds FROM a GROUP BY 1""")
def ml07_four_arms(spark, d):
    """Prior, metadata, generic and event models on the same folds: error, difference to the prior, folds won."""
    x = design(spark, d).withColumn("zero", F.lit(0.0))
    out = trials.compared_arms(x, "fold", "role", "y", {"prior": ["zero"], "metadata": ["x2"], "generic": ["x1"], "event": ["x1", "x2"]}, "prior", 10.0)
    return rounded(out, "mse", "delta")


def blocks_sql(circular: bool) -> str:
    span, wrap = ("n", "% n") if circular else ("(n - 13)", "")
    return f"""dr AS (SELECT fold, n, draw, j, ((draw * ((n + 13) // 14) + j) * 1103515245 + 7) % 2147483648 % {span} AS start FROM c, (SELECT unnest(range(100)) AS draw) d, LATERAL (SELECT unnest(range((n + 13) // 14)) AS j) j WHERE n >= 14),
m AS (SELECT dr.fold, draw, avg(x) AS mean FROM dr, (SELECT unnest(range(14)) AS o) o, p WHERE p.fold = dr.fold AND p.i = (start + o) {wrap} GROUP BY 1, 2)
SELECT fold, '{"circular" if circular else "whole"}' AS kind, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY 1"""


FOLDED = f"{TRADES}, q AS (SELECT (exit - 8000) // 360 AS fold, exit AS day, sum(net) / 1e6::DOUBLE AS x FROM t GROUP BY 1, 2), p AS (SELECT fold, x, row_number() OVER (PARTITION BY fold ORDER BY day) - 1 AS i FROM q), c AS (SELECT fold, count(*) AS n FROM p GROUP BY 1)"


@query(f"(WITH {FOLDED}, {blocks_sql(True)}) UNION ALL (WITH {FOLDED}, {blocks_sql(False)})")
def ml08_intervals_by_fold(spark, d):
    """Mean and 95 % interval of each fold by circular blocks and by blocks that lie wholly inside it."""
    r = trades(spark, d).groupBy(F.expr("(exit - 8000) div 360").alias("fold"), F.col("exit").alias("day")).agg((F.sum("net") / 1e6).alias("x"))
    both = [trials.fold_block_bootstrap(r, "fold", "day", "x", 14, 100, 7, circular).withColumn("kind", F.lit("circular" if circular else "whole")) for circular in (True, False)]
    out = both[0].unionByName(both[1]).groupBy("fold", "kind").agg(F.avg("mean").alias("m"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return rounded(out.select("fold", "kind", F.col("m").alias("mean"), "low", "high"), "mean", "low", "high")


@query(f"""WITH {TRADES}, p AS (SELECT net / 1e5::DOUBLE AS x, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM t), k AS (SELECT id // n AS draw, id, ('0x' || md5('17:' || id::VARCHAR)[1:12])::BIGINT % n AS i FROM (SELECT unnest(range(40 * n)) AS id, n FROM (SELECT count(*) AS n FROM t))),
e AS (SELECT draw, id, x, 1000 + sum(x) OVER (PARTITION BY draw ORDER BY id ROWS UNBOUNDED PRECEDING) AS v FROM k JOIN p USING (i)), g AS (SELECT draw, x, v, greatest(1000, max(v) OVER (PARTITION BY draw ORDER BY id ROWS UNBOUNDED PRECEDING)) AS peak FROM e),
m AS (SELECT draw, avg(x) AS mean, avg(x) / stddev_pop(x) AS sharpe, sum(CASE WHEN x > 0 THEN x ELSE 0 END) / -sum(CASE WHEN x < 0 THEN x ELSE 0 END) AS factor, max((peak - v) / peak) AS fall FROM g GROUP BY 1),
l AS (SELECT unnest(['mean', 'sharpe', 'profit_factor', 'drawdown']) AS metric, unnest([mean, sharpe, factor, fall]) AS v FROM m) SELECT metric, round(quantile_cont(v, 0.025), 5) AS low, round(quantile_cont(v, 0.5), 5) AS middle, round(quantile_cont(v, 0.975), 5) AS high FROM l GROUP BY 1""")
def ml10_trade_bootstrap(spark, d):
    """Intervals of mean, Sharpe ratio, profit factor and drawdown of as many trades as there are, drawn one by one with replacement."""
    out = paths.intervals(paths.trade_draws(trades(spark, d).withColumn("net", F.col("net") / 1e5), "o_orderkey", "net", 40, 17, 1000.0), ["mean", "sharpe", "profit_factor", "drawdown"])
    return out.select("metric", *(F.round(c, 5).alias(c) for c in ("low", "middle", "high")))


Q8 = [NormalDist().inv_cdf(1 - 1 / 8), NormalDist().inv_cdf(1 - 1 / (8 * 2.718281828459045))]
CDF = "(1 - exp(-z * z / 2) / 2.5066282746310002 * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"


@query(f"""WITH {RETURNS}, m AS (SELECT config, count(*) AS n, avg(r) AS a, stddev_samp(r) AS sd, stddev_pop(r) AS sp FROM rr GROUP BY 1), x AS (SELECT stddev_samp(a / sd) * ((1 - 0.5772156649015329::DOUBLE) * {Q8[0]!r}::DOUBLE + 0.5772156649015329::DOUBLE * {Q8[1]!r}::DOUBLE) AS best FROM m),
k AS (SELECT config, n, a / sd AS sharpe, avg(((r - a) / sp) ** 3) AS skew, avg(((r - a) / sp) ** 4) AS kurtosis FROM rr JOIN m USING (config) GROUP BY 1, 2, 3), g AS (SELECT config, best, (sharpe - best) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe ** 2) AS z FROM k, x),
h AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM g) SELECT config, round(best, 6) AS expected_best, round(z, 5) AS z, round(CASE WHEN z >= 0 THEN {CDF} ELSE 1 - {CDF} END, 5) AS probability FROM h""")
def ml16_deflated_by_trials(spark, d):
    """The probability that each configuration's Sharpe ratio exceeds the best that as many trials give by chance, which comes from the trials themselves."""
    out = trials.deflated_by_trials(run_returns(spark, d), "config", "r")
    return out.select("config", F.round("expected_best", 6).alias("expected_best"), F.round("z", 5).alias("z"), F.round("probability", 5).alias("probability"))


@query(f"""WITH {BARS_1D}, x AS (SELECT symbol, day, (CASE WHEN close > open THEN 1 ELSE 0 END)::DOUBLE AS weight, (volume % 2 < 1)::INT::DOUBLE AS meta, lead(close) {OVER}) / close - 1 AS r FROM b), y AS (SELECT * FROM x WHERE r IS NOT NULL),
o AS (SELECT *, row_number() {OVER}) - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n FROM y), j AS (SELECT o.*, q.weight AS shifted FROM o JOIN o q ON q.symbol = o.symbol AND q.t = ((o.t - 17) % o.n + o.n) % o.n)
SELECT symbol, arm, round(avg(w * r), 6) AS mean FROM (SELECT symbol, r, unnest(['real', 'metadata', 'shifted']) AS arm, unnest([weight, meta, shifted]) AS w FROM j) GROUP BY 1, 2""")
def ml17_metadata_and_shifted(spark, d):
    """Arms that know only metadata, or the weights of 17 rows before with wrap."""
    x = bars_1d(spark, d).select("symbol", "day", (F.col("close") > F.col("open")).cast("double").alias("weight"), (F.col("volume") % 2 < 1).cast("double").alias("meta"), (F.lead("close").over(W()) / F.col("close") - 1).alias("r")).where("r is not null")
    out = trials.shifted_arms(x, "symbol", "day", "weight", "meta", 17).groupBy("symbol", "arm").agg(F.avg(F.col("w") * F.col("r")).alias("mean"))
    return rounded(out, "mean")


@query(None)
def ml06_tail_classifier(spark, d):
    """The chance that a symbol's next day is among its worst tenth, by a logistic regression on what the day before showed; trained before day 9500. Tested against Newton's method."""
    x = bars_1d(spark, d).select("symbol", "day", (F.col("close") / F.col("open") - 1).alias("x1"), ((F.col("high") - F.col("low")) / F.col("open")).alias("x2"), (F.lead("close").over(W()) / F.col("close") - 1).alias("y"))
    x = written(x, "tail")  # a row a symbol and day, which labels, moments and each step of the fit read again
    train = F.col("day") < 9500
    labelled = models.tail_labels(x, "symbol", "y", train)
    return models.tail_classifier(labelled, ["x1", "x2"], "tail", train).select("symbol", "day", F.col("tail").cast("int").alias("tail"), F.round("probability", 6).alias("probability"))


def lengths_model():
    """A stand-in for a text model: a part is a word, its vector has a one at its length modulo 8."""
    import re

    word = re.compile(r"[a-z0-9]+")
    return lambda texts: [[[float(len(w) % 8 == i) for i in range(8)] for w in word.findall(t.lower())] for t in texts]


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT doc_id, length(w) % 8 AS dim, count(*) AS n FROM w GROUP BY 1, 2), m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)
SELECT doc_id, dim::BIGINT AS dim, round(n / norm, 6) AS value FROM c JOIN m USING (doc_id)""")
def ml22_embeddings(spark, d):
    """Mean of the word vectors of whole texts, of length one, by a pluggable model; the components that aren't zero."""
    e = models.embed_batches(table(spark, d, "documents"), lengths_model)
    return rounded(e.select("doc_id", F.posexplode("vector").alias("dim", "value")).where("value <> 0").withColumn("dim", F.col("dim").cast("long")), "value")
