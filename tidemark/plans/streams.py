"""Queries over streams: each runs over all rows of `events` and returns what the watermark has closed.

Queries with states of their own get the rows as eight micro-batches and are stopped and resumed after half of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.plans.registry import query, rounded
from tidemark.sources.readers import shared_folder, table
from tidemark.streaming import rolling, stateful

HOUR4 = 14_400_000_000
SEC = "epoch_us(ts) // 1000000"
#: The watermark when all rows have been seen: an hour before the last, in whole milliseconds.
CLOSED = "(SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM {})"
ALL = CLOSED.format("events")


def events(spark, d):
    schema = table(spark, d, "events").schema
    # a pattern, since a stream takes a table of one file only by one
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("qty", 1 + F.col("event_id") % 5).withColumn("side", F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell")).withColumn("size", F.col("value") * F.col("qty"))


def result(spark, stream, name, *times):
    out = rolling.written(stream, shared_folder(spark, name))
    return out.withColumns({t: F.unix_seconds(F.col(t).cast("timestamp")) for t in times})


@query(f"""WITH w AS (SELECT (epoch_us(ts) // {HOUR4} + unnest([1, 2, 3, 4, 5, 6])) * {HOUR4} AS e, value FROM events) SELECT e // 1000000 AS decision, round(avg(value), 6) AS mean, count(value) AS n FROM w WHERE e <= {ALL} GROUP BY 1""")
def sm01_rolling_scores(spark, d):
    return rounded(result(spark, rolling.rolling_scores(events(spark, d), "ts", "value"), "rolling", "decision"), "mean")


@query(f"""WITH w AS (SELECT ((epoch_us(ts) - 1) // {HOUR4} + unnest([1, 2, 3, 4, 5, 6])) * {HOUR4} AS e, value FROM events) SELECT e // 1000000 AS decision, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, count(value) AS n FROM w WHERE e <= {ALL} GROUP BY 1""")
def sm01_trailing_scores(spark, d):
    """Mean and median of the scores of (t - 24 h, t] at each four-hour boundary t."""
    return rounded(result(spark, rolling.trailing_scores(events(spark, d), "ts", "value"), "trailing", "decision"), "mean", "median")


@query(f"""SELECT (epoch_us(ts) // {HOUR4} + 1) * 14400 AS decision, event_type, count(*) AS n FROM events WHERE (epoch_us(ts) // {HOUR4} + 1) * {HOUR4} <= {ALL} GROUP BY 1, 2""")
def sm02_buckets(spark, d):
    return result(spark, rolling.event_buckets(events(spark, d), "ts", "event_type"), "buckets", "decision")


@query("SELECT DISTINCT user_id FROM events")
def sm03_first_seen(spark, d):
    return result(spark, rolling.first_seen(events(spark, d), "ts", ["user_id"], "60 days").select("user_id"), "seen")


@query("SELECT event_id, 'after capture' AS reason FROM events WHERE event_id % 10 = 3")
def sm04_quarantine(spark, d):
    """Rows published after their capture are set apart with a reason."""
    e = events(spark, d).withColumn("captured", F.when(F.col("event_id") % 10 == 3, F.col("ts") - F.expr("interval 1 minute")).otherwise(F.col("ts") + F.expr("interval 1 minute")))
    return result(spark, rolling.quarantine(e, "ts", "captured").where("reason is not null").select("event_id", "reason"), "quarantine")


@query(f"""WITH w AS (SELECT (epoch_us(ts) // {HOUR4} + 1) * {HOUR4} AS e, event_type, sum(CASE WHEN event_id % 2 = 0 THEN value * (1 + event_id % 5) ELSE 0 END) AS b, sum(CASE WHEN event_id % 2 = 1 THEN value * (1 + event_id % 5) ELSE 0 END) AS s FROM events GROUP BY 1, 2)
SELECT e // 1000000 AS decision, event_type, round(b, 6) AS bought, round(s, 6) AS sold, round(CASE WHEN b + s = 0 THEN 0 ELSE (b - s) / (b + s) END, 6) AS imbalance FROM w WHERE e <= {ALL}""")
def sm05_flow(spark, d):
    return rounded(result(spark, rolling.flow(events(spark, d), "ts", "event_type", "size", "side"), "flow", "decision"), "bought", "sold", "imbalance")


DAILY = f"""w AS (SELECT epoch_us(ts) // 86400000000 AS day, count(*) AS n, sum((value > 50)::INT)::BIGINT AS wins, sum((value < 50)::INT)::BIGINT AS losses, sum(value - 50) AS net FROM events GROUP BY 1),
c AS (SELECT day * 86400 AS day, n, wins, losses, net FROM w WHERE (day + 1) * 86400000000 <= {ALL})"""


@query(f"WITH {DAILY} SELECT day, n, wins, losses, round(net, 4) AS net FROM c")
def sm06_daily_summary(spark, d):
    s = rolling.daily_summary(events(spark, d).withColumn("net", F.col("value") - 50), "ts", "net")
    return result(spark, s, "daily", "day").withColumn("net", F.round("net", 4))


@query(f"WITH {DAILY} SELECT day, round(net, 4) AS net FROM c WHERE net < -10")
def sm07_loss_alerts(spark, d):
    s = rolling.loss_alerts(events(spark, d).withColumn("net", F.col("value") - 50), "ts", "net", 10.0)
    return result(spark, s, "alerts", "day").withColumn("net", F.round("net", 4))


@query(f"SELECT DISTINCT event_type, epoch_us(ts) // {HOUR4} * 14400 AS candle FROM events")
def sm08_one_per_candle(spark, d):
    return result(spark, rolling.one_per_candle(events(spark, d), "ts", "event_type", "candle").select("event_type", "candle"), "candles", "candle")


@query(f"""WITH l AS (SELECT *, value * (1 + event_id % 5) AS size FROM events WHERE value * (1 + event_id % 5) >= 100)
SELECT (epoch_us(ts) // {HOUR4} + 1) * 14400 AS decision, event_type, round(least(greatest(sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE -2 END * least(size / 500, 1)), -10), 10), 6) AS score, count(*) AS n FROM l
WHERE (epoch_us(ts) // {HOUR4} + 1) * {HOUR4} <= {CLOSED.format("l")} GROUP BY 1, 2""")
def sm09_transfer_alerts(spark, d):
    return rounded(result(spark, rolling.transfer_alerts(events(spark, d), "ts", "event_type", "size", "side", 100.0, 500.0), "transfers", "decision"), "score")


@query(f"""WITH x AS (SELECT event_type, ts, epoch_us(ts) AS us FROM events WHERE value > 60), g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY event_type ORDER BY us) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM x),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT event_type, min(us) // 1000000 AS start, (max(us) + 7200000000) // 1000000 AS end, count(*) AS n FROM s GROUP BY event_type, session HAVING max(us) + 7200000000 <= {CLOSED.format("x")}""")
def sm10_trigger_sessions(spark, d):
    return result(spark, rolling.trigger_sessions(events(spark, d).where("value > 60"), "ts", "event_type", "2 hours"), "sessions", "start", "end")


@query("""SELECT o.event_id AS opened, e.event_id AS event FROM events o JOIN events e ON o.user_id = e.user_id AND e.ts > o.ts AND e.ts < o.ts + INTERVAL 2 HOUR WHERE o.event_type = 'purchase' AND e.event_type = 'error'""")
def sm11_events_in_life(spark, d):
    """Errors of a user within two hours of a purchase: two streams joined over an interval."""
    opened = events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("opened"), "user_id", F.col("ts").alias("start"))
    seen = events(spark, d).where("event_type = 'error'").select(F.col("event_id").alias("event"), "user_id", "ts")
    return result(spark, rolling.events_in_life(opened, seen, "user_id", "start", "ts", "2 hours").select("opened", "event"), "life")


@query("SELECT event_id, round(CASE WHEN value > 60 THEN 1 ELSE value / 60 END, 6) AS score FROM events")
def sm14_resumable_scores(spark, d):
    score = F.when(F.col("value") > 60, 1.0).otherwise(F.col("value") / 60)
    return rounded(rolling.scored_once(events(spark, d), shared_folder(spark, "scores"), "event_id", score), "score")


@query("""WITH k AS (SELECT event_id, array_to_string(list_filter([CASE WHEN NOT value > 10 THEN 'score' END, CASE WHEN NOT event_id % 5 > 0 THEN 'size' END, CASE WHEN event_type = 'error' THEN 'kind' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events)
SELECT event_id, reasons, CASE WHEN reasons = '' THEN 'act' ELSE 'hold' END AS decision FROM k""")
def sm15_decisions(spark, d):
    """A signal acts when every gate holds; else the gates that failed are named."""
    gates = {"score": F.col("value") > 10, "size": F.col("event_id") % 5 > 0, "kind": F.col("event_type") != "error"}
    return result(spark, rolling.decisions(events(spark, d), gates).select("event_id", "reasons", "decision"), "decisions")


#: Micro-batches, the fewest files of one, and rows of a file: a batch has the more files, the larger the table.
BATCHES, FILES, ROWS = 8, 2, 250_000


def stores(spark, files):
    """Parts of a stream's state for micro-batches of `files` files: as many as there are cores or files, but no more than buckets of keys, nor than the session's parts of a shuffle.

    Each part has a store that is opened and committed, and a Python worker that starts, in every micro-batch, also where hardly a row comes to it.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), stateful.BUCKETS, max(spark.sparkContext.defaultParallelism, files))


def resumed(spark, d, make, name, jitter=0):
    """What `make` gives of events that arrive in `BATCHES` micro-batches by time (moved by up to `jitter` seconds, so that rows come out of order), stopped after half of them and resumed from its checkpoint."""
    folder, out = shared_folder(spark, name + "-in"), shared_folder(spark, name)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    files = max(FILES, math.ceil(e.count() / BATCHES / ROWS))
    moved = F.unix_micros("ts") + (F.col("event_id") * 7919 % (jitter + 1)) * 1_000_000
    # stateful processors need Spark's store of states on disk
    held = {"spark.sql.streaming.stateStore.providerClass": stateful.ROCKS, "spark.sql.shuffle.partitions": str(stores(spark, files))}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for half in (range(BATCHES // 2), range(BATCHES // 2, BATCHES)):
            rolling.dealt(e, moved, BATCHES, files, folder, half)
            found = rolling.written(make(rolling.arriving(spark, e.schema, folder, files)), out)
        return found
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def keyed(e, *more):
    """Events by user, as the stateful operators take them."""
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros("ts").alias("at"), *more)


FIRST = f"epoch_us(ts) // 1000 + 1 <= {ALL} // 1000"


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id::VARCHAR) AS i FROM events)
SELECT event_id, user_id, epoch_us(ts) AS us, event_type, value, props FROM f WHERE i = 1 AND {FIRST}""")
def sm03_first_captures(spark, d):
    """The whole first row of each user, kept by state until no earlier one can come; rows arrive up to 50 minutes out of order."""
    make = lambda e: stateful.first_captures(e, ["user_id"], "ts", "event_id")
    return resumed(spark, d, make, "captures", 3000).select("event_id", "user_id", F.unix_micros("ts").alias("us"), "event_type", "value", "props")


@query(f"""WITH f AS (SELECT *, epoch_us(ts) // {HOUR4} * 14400 AS candle, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // {HOUR4} ORDER BY epoch_us(ts), event_id::VARCHAR) AS i FROM events)
SELECT event_id, event_type, candle, value FROM f WHERE i = 1 AND {FIRST}""")
def sm08_first_signals(spark, d):
    """The first signal of each kind and four-hour candle, whole; rows arrive up to 50 minutes out of order."""
    make = lambda e: stateful.first_captures(e.withColumn("candle", F.expr("unix_seconds(ts) div 14400 * 14400")), ["event_type", "candle"], "ts", "event_id", forget="5 hours")
    return resumed(spark, d, make, "signals", 3000).select("event_id", "event_type", "candle", "value")


@query("""WITH r AS (SELECT user_id AS k, epoch_us(ts) // 86400000000 AS day, event_id AS id, sum(value - 30) OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY epoch_us(ts), event_id) AS total, epoch_us(ts) AS us FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY k, day ORDER BY us, id) AS i FROM r WHERE total < -25) SELECT k AS key, day, id, round(total, 6) AS total FROM f WHERE i = 1""")
def sm07_running_losses(spark, d):
    """The row on which a user's running result of the day first falls below the limit."""
    make = lambda e: stateful.running_losses(keyed(e, (F.col("value") - 30).alias("value"), "ts").withColumn("day", F.expr("at div 86400000000")), "ts", 25.0)
    return rounded(resumed(spark, d, make, "losses"), "total")


@query("""WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
p AS (SELECT k, id, i, CASE WHEN v > 25 THEN v END AS entry, CASE WHEN v > 25 THEN v END AS peak, NULL::DOUBLE AS stop FROM e WHERE i = 1
  UNION ALL SELECT e.k, e.id, e.i, CASE WHEN p.entry IS NULL THEN CASE WHEN e.v > 25 THEN e.v END WHEN e.v <= greatest(0.5::DOUBLE * p.entry, 0.6::DOUBLE * p.peak) THEN NULL ELSE p.entry END,
    CASE WHEN p.entry IS NULL THEN CASE WHEN e.v > 25 THEN e.v END WHEN e.v <= greatest(0.5::DOUBLE * p.entry, 0.6::DOUBLE * p.peak) THEN NULL ELSE greatest(p.peak, e.v) END, CASE WHEN p.entry IS NOT NULL THEN greatest(0.5::DOUBLE * p.entry, 0.6::DOUBLE * p.peak) END FROM p JOIN e ON e.k = p.k AND e.i = p.i + 1)
SELECT k AS key, id, (entry IS NOT NULL)::INTEGER AS held, round(stop, 6) AS stop FROM p""")
def sm12_positions(spark, d):
    """Whether each user's position is held after each event, and the trailing stop before it: long above a value, out at the larger of half the entry and 60 % of the peak."""
    return rounded(resumed(spark, d, lambda e: stateful.positions(keyed(e, "value"), 25.0, 0.5, 0.6), "positions"), "stop")


@query("""WITH e AS (SELECT user_id AS k, event_id AS id, epoch_us(ts) AS us, value AS v, event_id * 7 % 50 AS a, event_id * 11 % 60 AS b FROM events),
w AS (SELECT *, list((v - a) ** 2) OVER s AS ea, list((v - b) ** 2) OVER s AS eb FROM e WINDOW s AS (PARTITION BY k ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000 PRECEDING)),
m AS (SELECT k, id, a, b, CASE WHEN len(ea) > 0 THEN 1 / greatest(list_avg(list_slice(ea, -10, -1)), 1e-12::DOUBLE) END AS x, CASE WHEN len(eb) > 0 THEN 1 / greatest(list_avg(list_slice(eb, -10, -1)), 1e-12::DOUBLE) END AS y FROM w)
SELECT k AS key, id, round(x / (x + y), 6) AS weight, round(x / (x + y) * a + (1 - x / (x + y)) * b, 6) AS fused FROM m""")
def sm13_fusion(spark, d):
    """Two forecasts of each user's events, weighted by their errors on the last ten events whose outcome was an hour old."""
    forecasts = (F.col("event_id") * 7 % 50).cast("double").alias("a"), (F.col("event_id") * 11 % 60).cast("double").alias("b")
    return rounded(resumed(spark, d, lambda e: stateful.fusion(keyed(e, "value", *forecasts), 10, 3_600_000_000), "fusion"), "weight", "fused")
