"""Ledgers held against each other, growth and drawdown of results, and measures of an order book.

Cases: null components count as a difference unless both sides lack them; results of a key with no row are absent; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reconcile(recomputed: DataFrame, reported: DataFrame, key: str, parts: list[str], tolerance: float) -> DataFrame:
    """key, parts, error: trades whose components differ by more than `tolerance` (their names, the largest difference), and trades that one ledger lacks (parts `missing`, no error)."""
    a = recomputed.select(F.col(key).alias("a_key"), *(F.col(p).alias(f"a_{p}") for p in parts))
    b = reported.select(F.col(key).alias("b_key"), *(F.col(p).alias(f"b_{p}") for p in parts))
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full")
    gap = {p: F.when(F.col(f"a_{p}").isNull() & F.col(f"b_{p}").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col(f"a_{p}") - F.col(f"b_{p}")), F.lit(float("inf")))) for p in parts}
    names = F.array_join(F.array_compact(F.array(*(F.when(g > tolerance, p) for p, g in gap.items()))), ",")
    alone = F.col("a_key").isNull() | F.col("b_key").isNull()
    out = both.select(F.coalesce("a_key", "b_key").alias(key), F.when(alone, "missing").otherwise(names).alias("parts"), F.when(~alone, F.greatest(*gap.values()) if len(gap) > 1 else next(iter(gap.values()))).alias("error"))
    return out.where("parts <> ''")


def _with_fall(rows: DataFrame, key: str, time: str, r: str) -> DataFrame:
    """`fall`: the drawdown from the peak so far, 1 at the start. One row a time."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("grown", F.sum(F.log1p(r)).over(w))
    return x.withColumn("fall", 1 - F.exp(F.col("grown") - F.greatest(F.max("grown").over(w), F.lit(0.0)))).drop("grown")


def growth(rows: DataFrame, key: str, day: str, r: str, periods: float) -> DataFrame:
    """key, cagr (over the days from first to last), drawdown, calmar (null without a drawdown) of one result a day."""
    g = _with_fall(rows, key, day, r).groupBy(key).agg(F.exp(F.sum(F.log1p(r))).alias("total"), (F.max(day) - F.min(day) + 1).alias("days"), F.max("fall").alias("drawdown"))
    g = g.withColumn("cagr", F.pow("total", periods / F.col("days")) - 1)
    return g.select(key, "cagr", "drawdown", F.when(F.col("drawdown") > 0, F.col("cagr") / F.col("drawdown")).alias("calmar"))


def summary(series: DataFrame, arm: str, time: str, net: str, turnover: str, periods: float) -> DataFrame:
    """arm, days, total, annual, mean, drawdown, turnover of a series with one row a time."""
    x = _with_fall(series, arm, time, net)
    grown = F.sum(F.log1p(net))
    return x.groupBy(arm).agg(
        F.count(F.lit(1)).alias("days"), F.expm1(grown).alias("total"), F.expm1(grown * periods / F.count(F.lit(1))).alias("annual"), F.avg(net).alias("mean"), F.max("fall").alias("drawdown"), F.sum(turnover).alias("turnover")
    )


def book_measures(books: DataFrame, bids: str, asks: str) -> DataFrame:
    """Adds mid, spread_bps, bid_depth, ask_depth and book_imbalance of arrays of levels (price, size), best from the levels themselves; null where a side is empty or prices are zero."""
    depth = lambda side: F.aggregate(side, F.lit(0.0), lambda total, level: total + level["price"] * level["size"])
    best_bid, best_ask = F.array_max(F.transform(bids, lambda x: x["price"])), F.array_min(F.transform(asks, lambda x: x["price"]))
    x = books.withColumns({"bid_depth": depth(bids), "ask_depth": depth(asks), "mid": (best_bid + best_ask) / 2, "spread_bps": (F.try_divide(best_ask, best_bid) - 1) * 10_000})
    return x.withColumn("book_imbalance", F.try_divide(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth")))
