"""Domain tables derived from the given tables, as DataFrames and as the CTEs that the SQL of the queries starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import table

SLOT = 14_400  # seconds of a four-hour bar
DAY = 86_400


def ticks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("symbol"), "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), F.col("value").alias("price"),
        (1 + F.col("event_id") % 5).alias("qty"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
    )


def bars_4h(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("us", "event_id")
    return ticks(spark, d).groupBy("symbol", F.expr(f"us div {SLOT}000000").alias("slot")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("turnover"),
    )


def bars_1d(spark: SparkSession, d: str, letter: str = "S", symbols: int = 5) -> DataFrame:
    l = table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))  # noqa: E741
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.groupBy(F.concat(F.lit(letter), F.col("l_partkey") % symbols).alias("symbol"), F.expr("cast(unix_date(cast(l_shipdate as date)) as bigint)").alias("day")).agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"),
    )


def settlements(spark: SparkSession, d: str) -> DataFrame:
    """Every event settles its symbol's rate."""
    return ticks(spark, d).select("symbol", "event_id", F.expr("us div 1000000").alias("sec"), ((F.col("price") - 20) / 10000).alias("rate"))


def news(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", F.substring_index("text", "\n", 1).alias("headline"), (F.lit(1704067200) + F.col("doc_id") * 37 % 43200 * 60).alias("published"), (F.col("doc_id") % 10 == 0).alias("date_only"),
        F.col("source").alias("domain"), F.col("lang").alias("coin"), F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), F.col("doc_id") % 900, F.lit("/")).alias("url"), "n_chars",
    )


def event_records(spark: SparkSession, d: str) -> DataFrame:
    n = news(spark, d)
    i = F.col("doc_id")
    asset = F.concat(F.lit("S"), i % 5)
    return n.select(
        "doc_id", "domain", "published", F.concat(F.lit("t"), i % 10).alias("event_type"), (i % 4).alias("direction"), (F.col("n_chars") % 101 / 100).alias("severity"), (i % 53 / 52).alias("surprise"),
        (0.5 + i % 50 / 100).alias("confidence"), F.when(i % 3 == 0, F.array(asset, F.concat(F.lit("S"), (i + 1) % 5))).otherwise(F.array(asset)).alias("assets"),
        F.when(i % 97 == 0, "error").otherwise("success").alias("status"), F.expr(f"published div {DAY}").alias("day"),
    )


def run(spark: SparkSession, d: str, second: bool = False) -> DataFrame:
    """Scores of one of two scoring runs; the second differs where the id is divisible by 11."""
    i = F.col("doc_id")
    score = i * 7 % 101 / 100 + (F.when(i % 11 == 0, 0.25).otherwise(0.0) if second else F.lit(0.0))
    return table(spark, d, "documents").select("doc_id", score.alias("score"), F.when(score > 0.5, "long").otherwise("flat").alias("action"), (0.5 + i % 50 / 100).alias("confidence"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 997 / 997).alias("p"))


def trades(spark: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    """Orders as trades of the daily bars (`bars`, where they are at hand): entry at the open of the entry day, exit at the close of the exit day, where both bars exist."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("S"), F.col("o_custkey") % 5).alias("symbol"), F.expr("cast(unix_date(cast(o_orderdate as date)) as bigint)").alias("entry"), "o_totalprice", F.col("o_orderstatus").alias("reason"))
    o = o.withColumn("exit", F.col("entry") + 1 + F.col("o_orderkey") % 20)
    b = bars_1d(spark, d) if bars is None else bars
    o = o.join(b.select("symbol", F.col("day").alias("entry"), F.col("open").alias("entry_price")), ["symbol", "entry"]).join(b.select("symbol", F.col("day").alias("exit"), F.col("close").alias("exit_price")), ["symbol", "exit"])
    return o.withColumn("qty", F.col("o_totalprice") / F.col("entry_price")).withColumn("gross", F.col("qty") * (F.col("exit_price") - F.col("entry_price"))).withColumn(
        "fees", 0.001 * F.col("qty") * (F.col("exit_price") + F.col("entry_price"))).withColumn("net", F.col("gross") - F.col("fees"))


TICKS = "ticks AS (SELECT event_type AS symbol, event_id, epoch_us(ts) AS us, value AS price, 1 + event_id % 5 AS qty, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events)"
BARS_4H = f"""{TICKS}, b4 AS (SELECT symbol, us // {SLOT}000000 AS slot, arg_min(price, us * 10000000 + event_id % 10000000) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, us * 10000000 + event_id % 10000000) AS close, sum(qty)::BIGINT AS volume, sum(price * qty) AS turnover FROM (SELECT symbol, us::HUGEINT AS us, event_id, price, qty FROM ticks) GROUP BY 1, 2)"""
BARS_1D = """b AS (SELECT 'S' || (l_partkey % 5) AS symbol, (l_shipdate::DATE - DATE '1970-01-01')::BIGINT AS day, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover
  FROM (SELECT *, l_extendedprice / l_quantity AS p, ((l_orderkey * 16 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS k FROM lineitem) GROUP BY 1, 2)"""
SETTLEMENTS = f"{TICKS}, s AS (SELECT symbol, event_id, us // 1000000 AS sec, (price - 20) / 10000 AS rate FROM ticks)"
NEWS = """n AS (SELECT doc_id, split_part(text, chr(10), 1) AS headline, 1704067200 + doc_id * 37 % 43200 * 60 AS published, doc_id % 10 = 0 AS date_only, source AS domain, lang AS coin,
  'https://www.' || source || '.example.com/' || (doc_id % 900) || '/' AS url, n_chars FROM documents)"""
RECORDS = f"""{NEWS}, r AS (SELECT doc_id, domain, published, 't' || (doc_id % 10) AS event_type, doc_id % 4 AS direction, (n_chars % 101) / 100 AS severity, (doc_id % 53) / 52 AS surprise, 0.5::DOUBLE + (doc_id % 50) / 100 AS confidence,
  CASE WHEN doc_id % 3 = 0 THEN ['S' || (doc_id % 5), 'S' || ((doc_id + 1) % 5)] ELSE ['S' || (doc_id % 5)] END AS assets, CASE WHEN doc_id % 97 = 0 THEN 'error' ELSE 'success' END AS status, published // {DAY} AS day FROM n)"""
RUNS = """ra AS (SELECT doc_id, sc AS score, CASE WHEN sc > 0.5 THEN 'long' ELSE 'flat' END AS action, 0.5::DOUBLE + (doc_id % 50) / 100 AS confidence FROM (SELECT doc_id, (doc_id * 7 % 101) / 100 AS sc FROM documents)),
rb AS (SELECT doc_id, sc AS score, CASE WHEN sc > 0.5 THEN 'long' ELSE 'flat' END AS action, 0.5::DOUBLE + (doc_id % 50) / 100 AS confidence FROM (SELECT doc_id, (doc_id * 7 % 101) / 100 + CASE WHEN doc_id % 11 = 0 THEN 0.25::DOUBLE ELSE 0 END AS sc FROM documents))"""
SCORED = "sc AS (SELECT doc_id, quality AS label, (n_chars % 997) / 997 AS p FROM labels JOIN documents USING (doc_id))"
TRADES = f"""{BARS_1D}, o AS (SELECT o_orderkey, 'S' || (o_custkey % 5) AS symbol, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS entry, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT + 1 + o_orderkey % 20 AS exit, o_totalprice, o_orderstatus AS reason FROM orders),
t AS (SELECT *, gross - fees AS net FROM (SELECT *, qty * (exit_price - entry_price) AS gross, 0.001 * qty * (exit_price + entry_price) AS fees FROM (
  SELECT o.*, e.open AS entry_price, x.close AS exit_price, o_totalprice / e.open AS qty FROM o JOIN b e ON e.symbol = o.symbol AND e.day = o.entry JOIN b x ON x.symbol = o.symbol AND x.day = o.exit)))"""
