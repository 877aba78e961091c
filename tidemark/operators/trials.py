"""Splits, ridge regression from sums, resampling and selection tests over few rows per day or block."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import paths


def date_blocks(rows: DataFrame, day: str, initial: float, blocks: int) -> DataFrame:
    """day, block: 0 for the first `initial` share of the distinct days, then 1 to `blocks` in order. One row a day meets the window."""
    all_ = Window.partitionBy(F.lit(0))
    d = rows.select(day).distinct().withColumn("__i", F.row_number().over(all_.orderBy(day)) - 1).withColumn("__n", F.count(F.lit(1)).over(all_))
    first = F.floor(F.col("__n") * initial)
    return d.select(day, F.when(F.col("__i") < first, 0).otherwise(F.floor((F.col("__i") - first) * blocks / (F.col("__n") - first)) + 1).cast("long").alias("block"))


def gram(rows: DataFrame, by: list[str], features: list[str], y: str) -> DataFrame:
    """One row per group with every sum that ridge regression needs: n, sums, and sums of products of the features and y."""
    cols = [*features, y]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)), *products)


def _sums(row, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    s = np.array([row[f"s_{i}"] for i in range(k)])
    p = np.array([[row[f"p_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return row["n"], s, p


def ridge(row, k: int, alpha: float) -> tuple[np.ndarray, float]:
    """Slopes (on the raw features) and intercept from one row of `gram`; k features, standardised by the population deviation; constant ones get no slope."""
    n, s, p = _sums(row, k + 1)
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    scale = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
    beta = scale * np.linalg.solve(n * (cov[:k, :k] * np.outer(scale, scale)) + alpha * np.eye(k), n * cov[:k, k] * scale)
    return beta, float(mean[k] - beta @ mean[:k])


def squared_error(row, k: int, beta: np.ndarray, intercept: float) -> float:
    """Mean squared error of a linear prediction on the rows that one row of `gram` sums up."""
    n, s, p = _sums(row, k + 1)
    c = np.append(-beta, 1.0)
    return float((c @ p @ c - 2 * intercept * (c @ s) + n * intercept**2) / n)


def ridge_by_fold(rows: DataFrame, fold: str, role: str, features: list[str], y: str, alphas: list[float]) -> DataFrame:
    """fold, alpha, mse on the fold's `valid` rows of a model fitted on its `train` rows.

    Spark sums the products; only one small row per fold and role reaches the driver, where k x k systems are solved. Folds lacking a role are left out.
    """
    k = len(features)
    sums = {(r[fold], r[role]): r for r in gram(rows, [fold, role], features, y).collect()}
    out = []
    for f in sorted({f for f, _ in sums}):
        if (f, "train") in sums and (f, "valid") in sums:
            out += [(f, float(a), squared_error(sums[f, "valid"], k, *ridge(sums[f, "train"], k, a))) for a in alphas]
    return rows.sparkSession.createDataFrame(out, f"{fold} long, alpha double, mse double")


def drawn(draws: int, picks: int, n: int, seed: int, spark) -> DataFrame:
    """draw, j, pick (0 to n - 1) with replacement, from a linear congruence that SQL can follow."""
    d = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(picks - 1))).alias("j"))
    return d.withColumn("pick", F.expr(f"cast(((draw * {picks} + j) * 1103515245 + {seed}) % 2147483648 % {n} as int)"))


def cluster_bootstrap(clusters: DataFrame, order: list[str], total: str, count: str, draws: int, seed: int) -> DataFrame:
    """draw, mean: clusters drawn with replacement, summed totals over summed counts. Draws meet cluster sums, not rows."""
    n = clusters.count()
    if not n:
        return clusters.sparkSession.createDataFrame([], "draw long, mean double")
    c = clusters.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).alias("pick"), F.col(total).alias("t"), F.col(count).alias("c"))
    return drawn(draws, n, n, seed, clusters.sparkSession).join(c, "pick").groupBy("draw").agg(F.try_divide(F.sum("t"), F.sum("c")).alias("mean"))


def path_bootstrap(returns: DataFrame, order: str, r: str, block: int, draws: int, seed: int) -> DataFrame:
    """draw, mean, sharpe (not annualised), growth (log of the total), total, drawdown of circular blocks of one row a day put end to end. Draws meet a summary of each block, not its days."""
    return paths.path_bootstrap(returns, order, r, block, draws, lambda d, k, n: drawn(d, k, n, seed, returns.sparkSession))


def one_sided_p(draws: DataFrame, value: str) -> DataFrame:
    return draws.agg(((1 + F.count_if(F.col(value) <= 0)) / (1 + F.count(F.lit(1)))).alias("p"))


def overfit(blocks: DataFrame, config: str, block: str, n_blocks: int, total: str, squares: str, count: str) -> DataFrame:
    """split, winner, place, logit: for each choice of half the blocks, the best configuration in them by Sharpe ratio, and its rank in the others.

    `blocks`: sums per configuration and block. Splits meet these sums only. The overfit probability is the share of logits at or below 0.
    """
    splits = blocks.sparkSession.range(1 << n_blocks).where(f"bit_count(id) = {n_blocks // 2}").select(F.col("id").alias("split"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias(block))
    side = F.expr(f"shiftright(split, cast({block} as int)) & 1")
    s = splits.withColumn("inside", side).join(blocks, block).groupBy("split", "inside", config).agg(F.sum(total).alias("t"), F.sum(squares).alias("q"), F.sum(count).alias("c"))
    m = F.col("t") / F.col("c")
    s = s.withColumn("sharpe", F.round(F.try_divide(m, F.sqrt(F.greatest(F.col("q") / F.col("c") - m * m, F.lit(0.0)))), 9))
    best = s.where("inside = 1").withColumn("i", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("sharpe"), config))).where("i = 1").select("split", F.col(config).alias("winner"))
    out = Window.partitionBy("split")
    ranked = s.where("inside = 0").withColumn("place", F.row_number().over(out.orderBy("sharpe", config))).withColumn("of", F.count(F.lit(1)).over(out))
    hit = ranked.join(best, "split").where(F.col(config) == F.col("winner"))
    share = F.col("place") / (F.col("of") + 1)
    return hit.select("split", "winner", F.col("place").cast("long").alias("place"), F.log(share / (1 - share)).alias("logit"))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a rational approximation of the error function (absolute error below 1e-7)."""
    # The published coefficients of the approximation.
    p, a = 0.2316419, [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = 1 / (1 + p * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    tail = F.exp(-z * z / 2) / F.lit(float(np.sqrt(2 * np.pi))) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def deflated_sharpe(returns: DataFrame, by: str, r: str, expected_max: float) -> DataFrame:
    """by, n, sharpe, skew, kurtosis, z, probability that the true Sharpe ratio exceeds the best of the trials expected by chance."""
    m = returns.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.avg(r), F.stddev_samp(r)).alias("sharpe"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurtosis"))
    s = F.col("sharpe")
    z = F.try_divide((s - expected_max) * F.sqrt(F.col("n") - 1), F.sqrt(1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s))
    return m.withColumn("z", z).withColumn("probability", normal_cdf(F.col("z")))


def placebo_arms(rows: DataFrame, key: str, time: str, weight: str, seed: str) -> DataFrame:
    """Rows once per `arm` with its `w`: the weight itself, delayed by one row, its opposite, the key's mean, and a shuffle within the key by hash order."""
    w = Window.partitionBy(key)
    by_hash = w.orderBy(F.sha2(F.concat(F.lit(seed), F.col(time).cast("string")), 256), time)
    order = rows.withColumn("__t", F.row_number().over(w.orderBy(time))).withColumn("__h", F.row_number().over(by_hash))
    other = order.select(F.col(key).alias("__k"), F.col("__h").alias("__g"), F.col(weight).alias("__other"))
    x = order.join(other, (F.col(key) == F.col("__k")) & (F.col("__t") == F.col("__g")))
    x = x.withColumn("__late", F.coalesce(F.lag(weight).over(w.orderBy(time)), F.lit(0.0))).withColumn("__mean", F.avg(weight).over(w))
    arms = {"real": F.col(weight), "delayed": F.col("__late"), "opposite": -F.col(weight), "constant": F.col("__mean"), "shuffled": F.col("__other")}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), c.cast("double").alias("w")) for n, c in arms.items())))
    return x.select(*rows.columns, each.alias("__a")).select(*rows.columns, "__a.arm", "__a.w")


def compared_arms(rows: DataFrame, fold: str, role: str, y: str, arms: dict[str, list[str]], base: str, alpha: float) -> DataFrame:
    """arm, mse and delta to the base arm (means over the folds), wins (folds with less error than the base), folds. All arms meet the same folds."""
    each = None
    for arm, features in arms.items():
        one = ridge_by_fold(rows, fold, role, features, y, [alpha]).select(F.lit(arm).alias("arm"), fold, "mse")
        each = one if each is None else each.unionByName(one)
    prior = each.where(F.col("arm") == base).select(fold, F.col("mse").alias("prior"))
    x = each.join(prior, fold)
    return x.groupBy("arm").agg(F.avg("mse").alias("mse"), F.avg(F.col("mse") - F.col("prior")).alias("delta"), F.count_if(F.col("mse") < F.col("prior")).alias("wins"), F.count(F.lit(1)).alias("folds"))


def fold_block_bootstrap(rows: DataFrame, fold: str, order: str, value: str, block: int, draws: int, seed: int, circular: bool) -> DataFrame:
    """fold, draw, mean of blocks drawn within each fold: circular, or such that lie wholly inside it. Folds shorter than a block have none. One row a day meets the window; draws meet block sums."""
    pos = rows.select(fold, F.col(value).alias("x"), (F.row_number().over(Window.partitionBy(fold).orderBy(order)) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(fold)).alias("n")).where(F.col("n") >= block)
    reach = F.explode(F.expr(f"transform(sequence(0, {block - 1}), o -> {'pmod(i - o, n)' if circular else 'i - o'})")).alias("start")
    sums = pos.select(fold, "x", "n", reach).where(F.lit(True) if circular else (F.col("start") >= 0) & (F.col("start") <= F.col("n") - block)).groupBy(fold, "start").agg(F.sum("x").alias("s"))
    k = F.ceil(F.col("n") / block).cast("long")
    d = pos.select(fold, "n").distinct().withColumn("k", k).withColumn("draw", F.explode(F.expr(f"sequence(0L, {draws - 1}L)"))).withColumn("j", F.explode(F.expr("sequence(0L, k - 1)")))
    span = "n" if circular else f"(n - {block - 1})"
    d = d.withColumn("start", F.expr(f"((draw * k + j) * 1103515245 + {seed}) % 2147483648 % {span}"))
    return d.join(sums, [fold, "start"]).groupBy(fold, "draw").agg((F.sum("s") / (F.first("k") * block)).alias("mean"))


def deflated_by_trials(returns: DataFrame, by: str, r: str) -> DataFrame:
    """`deflated_sharpe` against the best ratio expected by chance of as many trials, from the spread of the trials' own ratios; `expected_best` holds it. One trial, or trials alike, expect 0."""
    ratios = returns.groupBy(by).agg(F.try_divide(F.avg(r), F.stddev_samp(r)).alias("s"))
    n, spread = ratios.agg(F.count("s"), F.stddev_samp("s")).first()
    normal, euler = NormalDist(), 0.5772156649015329
    best = spread * ((1 - euler) * normal.inv_cdf(1 - 1 / n) + euler * normal.inv_cdf(1 - 1 / (n * math.e))) if n > 1 and spread else 0.0
    return deflated_sharpe(returns, by, r, best).withColumn("expected_best", F.lit(best))


def shifted_arms(rows: DataFrame, key: str, time: str, weight: str, metadata: str, shift: int) -> DataFrame:
    """Rows once per `arm` with its `w`: the weight, what metadata alone says, and the weight of `shift` rows before, with wrap. Rows of a key are bounded by the calendar."""
    w = Window.partitionBy(key)
    x = rows.withColumn("shift_t", F.row_number().over(w.orderBy(time)) - 1).withColumn("shift_n", F.count(F.lit(1)).over(w))
    other = x.select(F.col(key).alias("shift_k"), F.expr(f"(shift_t + {shift}) % shift_n").alias("shift_to"), F.col(weight).alias("shift_w"))
    x = x.join(other, (F.col(key) == F.col("shift_k")) & (F.col("shift_t") == F.col("shift_to")))
    arms = {"real": F.col(weight), "metadata": F.col(metadata), "shifted": F.col("shift_w")}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), c.cast("double").alias("w")) for n, c in arms.items())))
    return x.select(*rows.columns, each.alias("shift_a")).select(*rows.columns, "shift_a.arm", "shift_a.w")
