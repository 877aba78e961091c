"""Positions and their results: arms, overlays, valuation of given trades, levels and decaying text states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import free
from tidemark.operators.stats import hash_number, ranked
from tidemark.operators.timeline import asof_join


def arm_returns(rows: DataFrame, arm: str, key: str, time: str, weight: str, r: str, cost: float) -> DataFrame:
    """arm, time, gross, turnover, cost, net of weights over keys."""
    before = F.lag(weight).over(Window.partitionBy(arm, key).orderBy(time))
    x = rows.withColumn("__t", F.abs(F.col(weight) - F.coalesce(before, F.lit(0.0))))
    a = x.groupBy(arm, time).agg(F.sum(F.col(weight) * F.col(r)).alias("gross"), F.sum("__t").alias("turnover"))
    return a.withColumn("cost", cost * F.col("turnover")).withColumn("net", F.col("gross") - F.col("cost"))


def signed_returns(rows: DataFrame, key: str, time: str, side: str, r: str, funding: Column, cost: float) -> DataFrame:
    """`net` of a position of side 1 or -1: return, funding, cost of changes and of the exit on the key's last row."""
    w = Window.partitionBy(key).orderBy(time)
    s = F.col(side)
    change = F.abs(s - F.coalesce(F.lag(side).over(w), F.lit(0)))
    leaving = F.when(F.lead(time).over(w).isNull(), F.abs(s)).otherwise(0)
    return rows.withColumn("net", s * F.col(r) - s * funding - cost * (change + leaving))


def reallocated(trades: DataFrame, by: str, key: str, r: str, chosen: str, extra: float, seed: str) -> DataFrame:
    """Mean result as it is, with `extra` exposure on chosen trades, with the same budget on all, and on as many trades by hash order."""
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    x = trades.select(by, F.col(r).alias("x"), F.col(key).alias("id"), F.coalesce(F.col(chosen), F.lit(False)).cast("int").alias("up"), h.alias("h"))
    x = ranked(x, [by], hash_number(F.col("h")), ["h", "id"], "place")
    shares = x.groupBy(F.col(by).alias("of")).agg(F.sum("up").alias("ups"), F.avg("up").alias("share"))
    x = x.join(shares, F.col(by).eqNullSafe(F.col("of"))).withColumn("dealt", (F.col("place") <= F.col("ups")).cast("int"))
    mean = lambda c: F.avg(F.col("x") * (1 + extra * F.col(c)))
    return x.groupBy(by).agg(F.avg("x").alias("base"), mean("up").alias("raised"), mean("share").alias("matched"), mean("dealt").alias("shuffled"))


def half_for_a_bar(actions: DataFrame, bars: DataFrame, key: str, time: str, qty: str, slip: float, fee: float, funding: float) -> DataFrame:
    """price, fees, funding of selling half at the open of `time` and buying it back at the next one; actions without both bars are dropped."""
    sold, bought = free("half_sold", actions), free("half_bought", actions)
    out = bars.select(key, time, F.col("open").alias(sold))
    back = bars.select(key, (F.col(time) - 1).alias(time), F.col("open").alias(bought))
    half, a, b = 0.5 * F.col(qty), F.col(sold), F.col(bought)
    x = actions.join(out, [key, time]).join(back, [key, time])
    return x.withColumns({"price": half * (a * (1 - slip) - b * (1 + slip)), "fees": fee * half * (a + b), "funding": half * a * funding}).drop(sold, bought)


def attenuated(rows: DataFrame, key: str, time: str, warned: str, r: str, bars: int, full: float, low: float, cost: float) -> DataFrame:
    """Results at `full` exposure and at `low` for `bars` rows from each warning, changes costed, and the worst row of both."""
    w = Window.partitionBy(key).orderBy(time)
    x = rows.withColumn("__low", F.max(F.coalesce(F.col(warned), F.lit(False)).cast("int")).over(w.rowsBetween(-(bars - 1), 0)))
    x = x.withColumn("__moved", F.abs(F.col("__low") - F.coalesce(F.lag("__low").over(w), F.lit(0)))).withColumn("__e", F.when(F.col("__low") == 1, low).otherwise(full))
    ret, e = F.col(r), F.col("__e")
    return x.groupBy(key).agg(
        F.sum(full * ret).alias("base"), F.sum(e * ret - cost * (full - low) * F.col("__moved")).alias("attenuated"), F.min(full * ret).alias("base_worst"), F.min(e * ret).alias("worst")
    )


def value_trades(trades: DataFrame, rates: DataFrame, trade: str, key: str, slip: float) -> DataFrame:
    """`slippage`, `funding` and `net` of trades with quantity, prices and fees: funding adds the daily rates strictly between entry and exit.

    Rates become a running sum per key, so a trade meets two rows of it, not every day it was open.
    """
    w = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    total = rates.groupBy(key, F.col("day").alias("__day")).agg(F.sum("rate").alias("__r")).withColumn("__sum", F.sum("__r").over(w)).select(key, "__day", "__sum")


    ends = trades.select(trade, key, F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("entry").alias("__day")), F.struct(F.lit(1).alias("i"), F.greatest(F.col("exit") - 1, F.col("entry")).alias("__day")))).alias("e")).select(trade, key, "e.i", "e.__day")
    known = asof_join(ends, total, key, "__day", ["__sum"]).withColumn("__sum", F.coalesce("__sum", F.lit(0.0)))
    paid = known.groupBy(trade).agg(F.sum(F.when(F.col("i") == 1, F.col("__sum")).otherwise(-F.col("__sum"))).alias("__rate"))
    x = trades.drop("net").join(paid, trade).withColumn("slippage", slip * F.col("qty") * (F.col("entry_price") + F.col("exit_price"))).withColumn("funding", F.col("__rate") * F.col("qty") * F.col("entry_price"))
    return x.withColumn("net", F.col("gross") - F.col("slippage") - F.col("fees") - F.col("funding")).drop("__rate")


def decayed_state(items: DataFrame, kind: str, weight: str, time: str, step: int, steps: int) -> DataFrame:
    """slot, weight, items, dominant: at each boundary the items younger than `steps` boundaries, fading linearly with age; ties to the last kind.

    An item is exploded over the few slots that it reaches, and summed per slot and kind before anything is compared.
    """
    life = step * steps
    k = items.select(kind, weight, time, F.explode(F.expr(f"sequence({time} div {step} + 1, {time} div {step} + {steps})")).alias("slot"))
    age = F.col("slot") * step - F.col(time)
    per = k.where(age < life).groupBy("slot", kind).agg(F.sum(F.col(weight) * (1 - age / life)).alias("w"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.round("w", 9).alias("w"), F.col(kind).alias("kind")))
    return per.groupBy("slot").agg(F.sum("w").alias("weight"), F.sum("n").alias("items"), best.alias("b")).select("slot", "weight", "items", F.col("b.kind").alias("dominant"))


def risk_levels(rows: DataFrame, price: str, unit: str, stop: tuple[float, float], target: tuple[float, float], risk: float) -> DataFrame:
    """`stop`, `target` (multiples of a unit, capped as shares of the price) and the `size` that loses `risk` at the stop."""
    p, u = F.col(price), F.col(unit)
    distance = F.least(stop[0] * u, stop[1] * p)
    return rows.withColumn("stop", p - distance).withColumn("target", p + F.least(target[0] * u, target[1] * p)).withColumn("size", F.try_divide(F.lit(risk), distance))


def text_state(items: DataFrame, step: int, horizons: list[tuple[int, float]]) -> DataFrame:
    """What the items (doc_id, domain, at, pressure, base, mechanism, stage, signature) say at each boundary of `step` seconds while they are younger than the last horizon (hours).

    An item weighs its `base` (confidence times scope) times the masses of the horizons that it hasn't outlived. Per boundary: items, sources, applicable (base above zero), items and
    mass of adverse and supportive pressure, the stage and mechanism with the most mass (ties to the last name, `unknown` without any), `novel` signatures that nothing earlier has, and whether an item is `fresh` (of this step).
    An item is exploded over the few boundaries that it reaches; sums per stage and mechanism are formed before anything is compared.
    """
    life = horizons[-1][0] * 3600
    first = F.ceil(F.col("at") / step).cast("long")
    x = items.withColumn("slot", F.explode(F.sequence(first, first + -(-life // step)))).withColumn("age", (F.col("slot") * step - F.col("at")) / 3600).where(F.col("age") * 3600 < life)
    mass = sum((F.when(F.col("age") < h, m).otherwise(0.0) for h, m in horizons), F.lit(0.0))
    x = x.withColumn("w", F.col("base") * mass)
    per = x.groupBy("slot", "pressure", "stage", "mechanism", "signature", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("base") > 0).alias("some"), F.count_if(F.col("w") > 0).alias("heavy"), F.sum("w").alias("w"), F.min("age").alias("youngest"), F.max("age").alias("oldest")
    )
    of = lambda side, c: F.sum(F.when(F.col("pressure") == side, F.col(c)).otherwise(0))
    total = per.groupBy("slot").agg(
        F.sum("n").alias("items"), F.sum("some").alias("applicable"), of("adverse", "heavy").alias("adverse_items"), of("supportive", "heavy").alias("supportive_items"), of("adverse", "w").alias("adverse"), of("supportive", "w").alias("supportive"),
        (F.min("youngest") < step / 3600).alias("fresh"),
    )
    sources = per.select("slot", "domain").distinct().groupBy("slot").agg(F.count("domain").alias("sources"))
    novel = per.groupBy("slot", "signature").agg(F.max("oldest").alias("o")).groupBy("slot").agg(F.count_if(F.col("o") == 0).alias("novel"))
    pressing = per.where(F.col("pressure").isin("adverse", "supportive") & (F.col("heavy") > 0))
    most = lambda c: pressing.groupBy("slot", c).agg(F.round(F.sum("w"), 9).alias("w")).groupBy("slot").agg(F.max(F.struct("w", c)).alias("b")).select("slot", F.col(f"b.{c}").alias(c))
    out = total.join(sources, "slot").join(novel, "slot").join(most("stage"), "slot", "left").join(most("mechanism"), "slot", "left").fillna("unknown", ["stage", "mechanism"])
    return out.select("slot", "items", "sources", "applicable", "adverse_items", "supportive_items", "adverse", "supportive", "stage", "mechanism", "novel", "fresh")
