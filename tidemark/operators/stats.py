"""Statistics of scores, returns and trades as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.sources.readers import written


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Ranks come from counts of distinct values, so that no task sorts all rows."""
    ranked = with_rank(with_rank(rows, x, "__rx"), y, "__ry")
    return ranked.agg(F.corr("__rx", "__ry").alias("spearman"))


def running_counts(rows: DataFrame, x: str) -> DataFrame:
    """Per value of a numeric column: __c rows hold it, __before rows come before it. Nulls come first.

    Values are cut at approximate quantiles, which are literals and so the same whenever a task is run again; sums per part run over the few parts.
    """
    counts = rows.groupBy(x).agg(F.count(F.lit(1)).alias("__c"))
    parts = min(1000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = counts.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)] or [0.5])).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(x))) if bounds else F.lit(0)
    cut = counts.withColumn("__part", part)
    sums = cut.groupBy("__part").agg(F.sum("__c").alias("__s"))
    before = sums.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    within = F.sum("__c").over(Window.partitionBy("__part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("__w", F.coalesce(within, F.lit(0))).join(F.broadcast(before), "__part").select(x, "__c", (F.col("__b") + F.col("__w")).alias("__before"))


def with_rank(rows: DataFrame, x: str, out: str) -> DataFrame:
    """Average rank of ties over all rows, joined back by value."""
    ranks = running_counts(rows, x).select(F.col(x).alias("__x"), (F.col("__before") + (F.col("__c") + 1) / 2).alias(out))
    return rows.join(ranks, F.col(x).eqNullSafe(F.col("__x"))).drop("__x")


def up_to(rows: DataFrame, x: str, key: str, k: int) -> Column:
    """Condition: the row is one of the k first by x, then key (numeric, unique). No task sorts all rows."""

    def at(part: DataFrame, column: str, position: int):
        return running_counts(part, column).where((F.col("__before") < position) & (F.col("__before") + F.col("__c") >= position)).first()

    found = at(rows, x, k) if k > 0 else None
    if found is None:
        return F.lit(False)
    tied = at(rows.where(F.col(x) == found[0]), key, k - found["__before"])
    return (F.col(x) < found[0]) | ((F.col(x) == found[0]) & (F.col(key) <= tied[0]))


def regression_metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return rows.agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.corr(y, p).alias("pearson"), F.stddev_pop(p).alias("spread"),
        F.regr_slope(y, p).alias("slope"), F.regr_intercept(y, p).alias("intercept"),
    )


def binary_metrics(rows: DataFrame, label: str, p: str) -> DataFrame:
    """AUC with ties, Brier score, log loss, difference of mean scores."""
    ranked = with_rank(rows, p, "__r")
    y, q = F.col(label), F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    n1, n0 = F.sum(y), F.sum(1 - y)
    return ranked.agg(
        ((F.sum(F.col("__r") * y) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        (-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), (F.avg(F.when(y == 1, F.col(p))) - F.avg(F.when(y == 0, F.col(p)))).alias("separation"),
    )


def tercile_spread(rows: DataFrame, score: str, value: str, key: str) -> DataFrame:
    """Mean value of the top third by score less that of the bottom third, n // 3 rows each; ties by key. Rows without a score take no part."""
    rows = rows.where(F.col(score).isNotNull())
    n = rows.count()
    low, rest = up_to(rows, score, key, n // 3), up_to(rows, score, key, n - n // 3)
    return rows.agg((F.avg(F.when(~rest, F.col(value))) - F.avg(F.when(low, F.col(value)))).alias("spread"))


def compounded(r: Column) -> Column:
    return F.exp(F.sum(F.log1p(r))) - 1


def trade_statistics(trades: DataFrame, by: list[str], net: str = "net") -> DataFrame:
    """Counts, win rate, profit factor (null without a loss), mean win and loss, reward to risk."""
    x = F.col(net)
    win, loss = F.sum(F.when(x > 0, x).otherwise(0.0)), -F.sum(F.when(x < 0, x).otherwise(0.0))
    a, b = F.avg(F.when(x > 0, x)), -F.avg(F.when(x < 0, x))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x > 0).alias("wins"), (F.count_if(x > 0) / F.count(F.lit(1))).alias("win_rate"), F.when(loss > 0, win / loss).alias("profit_factor"),
        a.alias("mean_win"), b.alias("mean_loss"), (a / b).alias("reward_risk"),
    )


def return_statistics(returns: DataFrame, by: list[str], r: str, periods: float) -> DataFrame:
    """Total return, Sharpe and Sortino ratio, annualised by `periods`; sample deviation."""
    x = F.col(r)
    down = F.sqrt(F.avg(F.when(x < 0, x * x).otherwise(0.0)))
    return returns.groupBy(*by).agg(compounded(x).alias("total"), (F.avg(x) / F.stddev_samp(x) * periods**0.5).alias("sharpe"), F.when(down > 0, F.avg(x) / down * periods**0.5).alias("sortino"))


def ranked(rows: DataFrame, by: list[str], x: Column, order: list[str], out: str, parts: int = 200, slices: int = 64) -> DataFrame:
    """`rows` with their place (from 1) in their group by the numeric x, then `order`, and the group's size as `out`_n. Nulls of x come first; groups match by value, null with null.

    A group is cut at approximate quantiles of x, and ties of a part into `slices` of equal width of the first of `order` where that is a number; rows and cuts are written once, so that every task
    sees the same and what makes the rows runs once. A row finds its part by halving. Places are counts of the parts and slices before plus the place within one, so no task gets a whole group.
    """
    # The columns of `rows` travel as one struct, so none can clash with those of the ranking.
    taken = rows.select(*(F.col(c).alias(f"rank_g{i}") for i, c in enumerate(by)), *(F.col(c).alias(f"rank_k{i}") for i, c in enumerate(order)), x.alias("rank_x"), F.struct(*rows.columns).alias("rank_row"))
    groups, keys = [f"rank_g{i}" for i in range(len(by))], [f"rank_k{i}" for i in range(len(order))]
    names = [f"rank_b{i}" for i in range(len(by))]
    number = isinstance(taken.schema[keys[0]].dataType, T.NumericType)
    tie = F.col(keys[0]).cast("double") if number else F.lit(0.0)
    y = written(taken, "ranked")
    quantiles = F.percentile_approx("rank_x", [i / parts for i in range(1, parts)])
    cuts = y.groupBy(*groups).agg(F.array_distinct(F.coalesce(quantiles, F.array())).alias("rank_cuts"), F.min(tie).alias("rank_lo"), F.max(tie).alias("rank_hi"))
    cuts = written(cuts, "cuts").toDF(*names, "rank_cuts", "rank_lo", "rank_hi")
    same = lambda: reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(groups, names)), F.lit(True))
    part = F.when(F.col("rank_x").isNull(), -1).otherwise(_below("rank_cuts", F.col("rank_x"), parts))
    slice_ = F.coalesce(F.floor((tie - F.col("rank_lo")) / (F.col("rank_hi") - F.col("rank_lo") + 1) * slices).cast("int"), F.lit(-1))
    # A part of several values is in order of x first; only parts of one value are sliced.
    y = y.join(cuts, same()).withColumn("rank_part", part).withColumn("rank_tied", F.coalesce(F.get("rank_cuts", F.col("rank_part")) == F.col("rank_x"), F.lit(False)))
    y = y.withColumn("rank_slice", F.when(F.col("rank_x").isNull() | F.col("rank_tied"), slice_).otherwise(-2)).drop(*names, "rank_cuts", "rank_lo", "rank_hi")
    at = ["rank_part", "rank_tied", "rank_slice"]
    sums = y.groupBy(*groups, *at).agg(F.count(F.lit(1)).alias("rank_c"))
    before = Window.partitionBy(*groups).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(*groups, *at, F.coalesce(F.sum("rank_c").over(before), F.lit(0)).alias("rank_o"), F.sum("rank_c").over(Window.partitionBy(*groups)).alias("rank_n"))
    offset = offset.toDF(*names, "rank_p", "rank_t", "rank_s", "rank_o", "rank_n")
    within = F.row_number().over(Window.partitionBy(*groups, *at).orderBy("rank_x", *keys))
    placed = same() & (F.col("rank_part") == F.col("rank_p")) & (F.col("rank_tied") == F.col("rank_t")) & (F.col("rank_slice") == F.col("rank_s"))
    y = y.withColumn("rank_i", within).join(offset, placed)
    return y.select("rank_row.*", (F.col("rank_o") + F.col("rank_i")).alias(out), F.col("rank_n").alias(out + "_n"))


def _below(cuts: str, x: Column, most: int) -> Column:
    """How many of at most `most` ascending `cuts` are less than x, in steps of halving width."""
    steps = F.array(*(F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < x, at + step).otherwise(at))


def hash_number(text: Column) -> Column:
    """The first 52 bits of a hexadecimal hash as a number, which orders as the hash does up to ties."""
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("long")


def value_at_risk(returns: DataFrame, by: list[str], r: str, key: str, q: float = 0.05) -> DataFrame:
    """The index rule max(0, int(n q) - 1), and the mean of the rows up to it."""
    x = ranked(returns.select(*by, r, key), by, F.col(r), [key], "i")
    return x.where(F.col("i") - 1 <= F.greatest(F.floor(F.col("i_n") * q) - 1, F.lit(0))).groupBy(*by).agg(F.max(r).alias("var"), F.avg(r).alias("cvar"))


def expected_shortfall(returns: DataFrame, by: list[str], r: str, key: str, q: float = 0.1) -> DataFrame:
    x = ranked(returns.select(*by, r, key), by, F.col(r), [key], "i")
    return x.where(F.col("i") <= F.ceil(F.col("i_n") * q)).groupBy(*by).agg(F.avg(r).alias("shortfall"), F.min(r).alias("worst"))


def concentration(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Share of each key in the positive total, and the sum of squared shares."""
    total = rows.groupBy(key).agg(F.sum(value).alias("v")).withColumn("v", F.greatest("v", F.lit(0.0)))
    shared = total.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(0))))
    return shared.select(key, "share", F.sum(F.col("share") * F.col("share")).over(Window.partitionBy(F.lit(0))).alias("hhi"))


def leave_one_out(rows: DataFrame, key: str, value: str) -> DataFrame:
    total = rows.groupBy(key).agg(F.sum(value).alias("v"))
    return total.select(key, (F.sum("v").over(Window.partitionBy(F.lit(0))) - F.col("v")).alias("without"))


def holm(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Step-down adjusted p-values of a handful of tests."""
    w = Window.partitionBy(F.lit(0))
    order = w.orderBy(p, name)
    raw = (F.count(F.lit(1)).over(w) - F.row_number().over(order) + 1) * F.col(p)
    return tests.withColumn("__a", raw).withColumn("adjusted", F.least(F.lit(1.0), F.max("__a").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__a")


def sign_flip(clusters: DataFrame, value: str, order: str) -> DataFrame:
    """Exact two-sided test over all sign patterns of a few (at most 20) cluster sums."""
    n = clusters.count()
    if n > 20:
        raise ValueError("more than 2^20 sign patterns")
    c = clusters.select(F.col(value).alias("x"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).alias("i"))
    masks = clusters.sparkSession.range(1 << n).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("i"))
    flipped = masks.join(F.broadcast(c), "i").groupBy("m").agg(F.sum(F.when(F.expr("shiftright(m, i) & 1") == 1, -F.col("x")).otherwise(F.col("x"))).alias("s"))
    seen = clusters.agg(F.abs(F.sum(value)).alias("t"))
    return flipped.join(F.broadcast(seen)).agg((F.count_if(F.abs("s") >= F.col("t") * (1 - 1e-9)) / F.count(F.lit(1))).alias("p"))


def block_bootstrap(rows: DataFrame, order: str, value: str, block: int, draws: int, seed: int) -> DataFrame:
    """Circular block bootstrap of the mean: draw, mean. Block starts come from a linear congruence, so SQL can draw the same ones.

    Blocks are summed once for every start; a draw then joins its starts, so the rows are never multiplied by the draws.
    """
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "draw long, mean double")
    pos = rows.select(F.col(value).alias("x"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).alias("i"))
    starts = pos.select("x", F.explode(F.expr(f"transform(sequence(0, {block - 1}), o -> pmod(i - o, {n}))")).alias("start")).groupBy("start").agg(F.sum("x").alias("s"))
    k = -(-n // block)
    drawn = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    drawn = drawn.withColumn("start", F.expr(f"cast(((draw * {k} + j) * 1103515245 + {seed}) % 2147483648 % {n} as int)"))
    return drawn.join(starts, "start").groupBy("draw").agg((F.sum("s") / (k * block)).alias("mean"))


def composite(parts: list[tuple[float, str, list[tuple[float, float]], float]], limit: float) -> Column:
    """Weighted sum of scores by thresholds (the first that the column exceeds; else the last value), within +-limit."""
    total = F.lit(0.0)
    for weight, column, steps, rest in parts:
        score = F.lit(float(rest))
        for edge, value in reversed(steps):
            score = F.when(F.col(column) > edge, float(value)).otherwise(score)
        total = total + weight * score
    return F.least(F.greatest(total, F.lit(-limit)), F.lit(limit))


def cluster_error(rows: DataFrame, clusters: list[str], value: str, power: float = 2.8) -> DataFrame:
    """Cluster-robust standard error of the mean, and the smallest effect found with 80 % power. Sums per cluster suffice: residuals add up to sum - n x mean."""
    sums = rows.groupBy(*clusters).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    total, n = sums.agg(F.sum("__s"), F.sum("__n")).first()
    e = F.col("__s") - F.col("__n") * F.lit(total / n if n else None)
    se = F.sqrt(F.sum(e * e)) / n
    return sums.agg(F.count(F.lit(1)).alias("clusters"), se.alias("se"), (power * se).alias("mde"))


def correlation_mde(rows: DataFrame, by: list[str], z: float = 1.959963984540054 + 0.8416212335729143) -> DataFrame:
    """The smallest correlation found with 80 % power at 5 % for the rows of each group; groups of three or fewer have none."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 3").withColumn("mde", F.tanh(z / F.sqrt(F.col("n") - 3)))


def pooled(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """by, dim, mean, top: mean vector of length one (null for a zero mean) and largest component. Means are formed before the shuffle, one row per dimension."""
    x = rows.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("m"), F.max("x").alias("top"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(by)))
    return x.select(by, F.col("dim").cast("long").alias("dim"), F.when(norm > 0, F.col("m") / norm).alias("mean"), "top")


def difference_tests(pairs: DataFrame, a: str, b: str, periods: float) -> DataFrame:
    """n, sharpe_z (Jobson and Korkie), mean_t, information (annualised) of paired returns."""
    x, d = pairs, F.col(a) - F.col(b)
    m = x.agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.stddev_samp(a).alias("sa"), F.stddev_samp(b).alias("sb"), F.covar_samp(a, b).alias("k"), F.avg(d).alias("md"), F.stddev_samp(d).alias("sd")
    )
    variance = "2 * sa * sa * sb * sb - 2 * sa * sb * k + ma * ma * sb * sb / 2 + mb * mb * sa * sa / 2 - try_divide(ma * mb * k * k, sa * sb)"
    z, t = F.expr(f"try_divide(sb * ma - sa * mb, sqrt(try_divide({variance}, n)))"), F.expr("try_divide(md * sqrt(n), sd)")
    return m.select("n", z.alias("sharpe_z"), t.alias("mean_t"), (F.expr("try_divide(md, sd)") * periods**0.5).alias("information"))


def gates(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check_name, passed, all_passed: one row per named check of a one-row table; a check that is null fails."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("check_name"), F.coalesce(holds, F.lit(False)).alias("passed")) for name, holds in checks.items())))
    every = F.lit(True)
    for holds in checks.values():
        every = every & F.coalesce(holds, F.lit(False))
    return row.select(each.alias("g"), every.alias("all_passed")).select("g.check_name", "g.passed", "all_passed")
