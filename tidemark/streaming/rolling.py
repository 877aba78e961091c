"""Rolling operators on streams. Every event carries the time it became available, which is the event time; later rows than the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rolling_scores(events: DataFrame, time: str, score: str, length: str = "24 hours", step: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Mean and number of scores of each sliding window; a window may be used from its end on."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length, step))
    return w.agg(F.avg(score).alias("mean"), F.count(score).alias("n")).select(F.col("window.end").alias("decision"), "mean", "n")


def trailing_scores(events: DataFrame, time: str, score: str, length: str = "24 hours", step: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Mean, median and number of scores of (t - length, t] at each boundary t. Spark's windows hold their start, not their end, so times are moved a microsecond back."""
    back = events.withColumn("trailing_time", F.col(time) - F.expr("interval 1 microsecond"))
    w = back.withWatermark("trailing_time", late).groupBy(F.window("trailing_time", length, step))
    return w.agg(F.avg(score).alias("mean"), F.percentile(score, 0.5).alias("median"), F.count(score).alias("n")).select(F.col("window.end").alias("decision"), "mean", "median", "n")


def event_buckets(events: DataFrame, time: str, key: str, length: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Events of each key by the boundary after them."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length), key)
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("decision"), key, "n")


def first_seen(items: DataFrame, time: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first capture of each item, repeats within the watermark dropped."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def trigger_sessions(triggers: DataFrame, time: str, key: str, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Triggers of a key at most `gap` apart as one session, which ends `gap` after its last one. Spark's sessions end at equality, so theirs are a microsecond longer."""
    w = triggers.withWatermark(time, late).groupBy(F.session_window(time, gap + " 1 microsecond"), key)
    end = F.col("session_window.end") - F.expr("interval 1 microsecond")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), end.alias("end"), key, "n")


def quarantine(items: DataFrame, published: str, captured: str) -> DataFrame:
    """`reason` for rows that can't be: published after their capture, or without a time. Null for good rows; the sink splits on it."""
    return items.withColumn("reason", F.when(F.col(published).isNull() | F.col(captured).isNull(), "no time").when(F.col(published) > F.col(captured), "after capture"))


def flow(trades: DataFrame, time: str, key: str, size: str, side: str, length: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Bought and sold amounts of each key and window, and their imbalance (0 for no trade)."""
    bought, sold = (F.sum(F.when(F.col(side) == s, F.col(size)).otherwise(0.0)) for s in ("buy", "sell"))
    w = trades.withWatermark(time, late).groupBy(F.window(time, length), key).agg(bought.alias("bought"), sold.alias("sold"))
    imbalance = F.coalesce(F.try_divide(F.col("bought") - F.col("sold"), F.col("bought") + F.col("sold")), F.lit(0.0))
    return w.select(F.col("window.end").alias("decision"), key, "bought", "sold", imbalance.alias("imbalance"))


def daily_summary(trades: DataFrame, time: str, net: str, late: str = "1 hour") -> DataFrame:
    """Trades, wins, losses and result of each day."""
    x = F.col(net)
    w = trades.withWatermark(time, late).groupBy(F.window(time, "1 day"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(x > 0).alias("wins"), F.count_if(x < 0).alias("losses"), F.sum(x).alias("net")).select(F.col("window.start").alias("day"), "n", "wins", "losses", "net")


def loss_alerts(trades: DataFrame, time: str, net: str, limit: float, late: str = "1 hour") -> DataFrame:
    """Days whose result is below -limit."""
    return daily_summary(trades, time, net, late).where(F.col("net") < -limit).select("day", "net")


def one_per_candle(signals: DataFrame, time: str, key: str, candle: str, late: str = "5 hours") -> DataFrame:
    """The first signal of each key and candle. State is let go a candle and an hour after it, when no other signal of the candle can come in time."""
    return signals.withColumn(candle, F.window(time, "4 hours")["start"]).withWatermark(time, late).dropDuplicatesWithinWatermark([key, candle])


def transfer_alerts(transfers: DataFrame, time: str, key: str, size: str, side: str, least: float, full: float, late: str = "1 hour") -> DataFrame:
    """Large transfers of each key in four hours: up to two points each by side, within ten."""
    points = F.sum(F.when(F.col(side) == "buy", 2).otherwise(-2) * F.least(F.col(size) / full, F.lit(1.0)))
    w = transfers.where(F.col(size) >= least).withWatermark(time, late).groupBy(F.window(time, "4 hours"), key)
    return w.agg(F.least(F.greatest(points, F.lit(-10.0)), F.lit(10.0)).alias("score"), F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("decision"), key, "score", "n")


def events_in_life(opened: DataFrame, events: DataFrame, key: str, start: str, time: str, length: str, late: str = "1 hour") -> DataFrame:
    """Events of a key after the start of an open position and within `length` of it: both sides watermarked, so state is let go."""
    o = opened.withWatermark(start, late).withColumnRenamed(key, "__key")
    e = events.withWatermark(time, late)
    within = (F.col(key) == F.col("__key")) & (F.col(time) > F.col(start)) & (F.col(time) < F.col(start) + F.expr(f"interval {length}"))
    return o.join(e, within).drop("__key")


def decisions(signals: DataFrame, gates: dict) -> DataFrame:
    """`decision` and the names of the gates (name: condition) that a signal fails; null conditions fail."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in gates.items())))
    return signals.withColumn("reasons", F.array_join(failed, ",")).withColumn("decision", F.when(F.col("reasons") == "", "act").otherwise("hold"))


def written(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now into Parquet below `folder`, resumable by its checkpoint, and reads the result."""
    q = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("path", folder + "/out").option("checkpointLocation", folder + "/state").start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder + "/out")


def scored_once(stream: DataFrame, folder: str, key: str, score) -> DataFrame:
    """Scores each micro-batch in `foreachBatch`; a batch that is run again after a crash overwrites its own folder, so no row is written twice."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.select(key, score.alias("score")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", folder + "/state").start().awaitTermination()
    return stream.sparkSession.read.parquet(folder + "/out").select(key, "score")


def dealt(rows: DataFrame, time: Column, batches: int, files: int, folder: str, only: range | None = None) -> None:
    """Writes `rows` below `folder` as `batches` groups of `files` files by equal spans of `time` (a number), one group after another, as a feed would bring them; `only`: these groups."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    if low is None:
        return
    number = F.least(F.floor((time - low) * batches / (high - low + 1)), F.lit(batches - 1))
    for i in range(batches) if only is None else only:
        rows.where(number == i).repartition(files).write.mode("append").parquet(folder)


def arriving(spark: SparkSession, schema: StructType, folder: str, files: int) -> DataFrame:
    """A stream over what `dealt` has written, one group a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
