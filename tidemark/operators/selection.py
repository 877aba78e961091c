"""Ranking, top-k and sampling. Every order ends in a unique key.

Cases: a null group is a group of its own; null values stand last in descending orders and first in ascending ones; ties go to the smaller key; a group with fewer rows than asked for gives all of them;
an empty table gives an empty one; the columns that an operator names as its result replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import free
from tidemark.operators.stats import ranked


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= n)


def liquid_universe(bars: DataFrame, n: int, history: int, key: str = "symbol", time: str = "day", value: str = "turnover") -> DataFrame:
    """Per day the n keys with the largest value over `history` consecutive days up to it."""
    w = Window.partitionBy(key).orderBy(time).rangeBetween(-(history - 1), 0)
    n_days = free("history_n", bars)
    full = bars.withColumn("liquidity", F.sum(value).over(w)).withColumn(n_days, F.count(F.lit(1)).over(w)).where(F.col(n_days) == history).drop(n_days)
    return top_n(full, [time], [F.desc("liquidity"), F.asc(key)], n)


def top_and_bottom(rows: DataFrame, by: list[str], value: str, key: str, n: int) -> DataFrame:
    """`side` 1 for the n largest, -1 for the n smallest, 0 else; a row that is both is 1."""
    up = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.asc(key)))
    down = F.row_number().over(Window.partitionBy(*by).orderBy(F.asc(value), F.asc(key)))
    return rows.withColumn("side", F.when(up <= n, 1).when(down <= n, -1).otherwise(0))


def rank_sum(rows: DataFrame, by: list[str], values: list[str], key: str, share: int = 3) -> DataFrame:
    """Ordinal ranks by each value, summed; the ceil(n / share) best are chosen."""
    total = sum((F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(v), F.asc(key))) for v in values[1:]), F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(values[0]), F.asc(key))))
    ranked = rows.withColumn("rank_sum", total)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("rank_sum", key))
    return ranked.withColumn("chosen", place <= F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*by)) / share))


def hash_sample(rows: DataFrame, strata: list[str], key: str, seed: str, n: int) -> DataFrame:
    """n rows of each stratum with the smallest SHA-256 of seed and key; rows that repeat a key in the order of a hash of all that they hold (maps left out)."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    whole = F.xxhash64(*(F.col(c) for c, t in rows.dtypes if "map<" not in t))
    return top_n(rows, strata, [h, F.col(key), whole], n)


def even_sample(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """n evenly spaced rows per group, first and last included (all, if fewer). The first column of `order` is numeric."""
    name = free("even_place", rows)
    x = ranked(rows, by, F.col(order[0]), order, name)
    place, many = F.col(name) - 1, F.col(name + "_n")
    wanted = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (many - 1) / (n - 1) + 0.5) == place)
    return x.where((many <= n) | wanted).select(*rows.columns)


def stratum_minimum_then_fill(rows: DataFrame, stratum: str, key: str, seed: str, n: int) -> DataFrame:
    """One row per stratum, then the smallest hashes of all the rest up to n rows."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    first = F.row_number().over(Window.partitionBy(stratum).orderBy(h, key)) == 1
    a, b = free("fill_hash", rows), free("fill_first", rows)
    return rows.withColumn(a, h).withColumn(b, first.cast("int")).orderBy(F.desc(b), a, key).limit(n).drop(a, b)


def frequent(rows: DataFrame, value: str, n: int) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(n)


def tilted_pair(scores: DataFrame, time: str, key: str, score: str, first: str, second: str) -> DataFrame:
    """Weights of a pair per time: half each, tilted to the higher score by a quarter of the difference, within 0.25 and 0.75."""
    p = scores.where(F.col(key).isin(first, second)).groupBy(time).agg(F.max(F.when(F.col(key) == first, F.col(score))).alias("a"), F.max(F.when(F.col(key) == second, F.col(score))).alias("b"))
    p = p.dropna(subset=["a", "b"]).withColumn("w1", F.least(F.greatest(0.5 + 0.25 * (F.col("a") - F.col("b")), F.lit(0.25)), F.lit(0.75)))
    return p.select(time, "w1", (1 - F.col("w1")).alias("w2"))


def best_configuration(folds: DataFrame, config: str, value: str, *gates: Column) -> DataFrame:
    """config, total: of the configurations whose folds pass the gates (on good, worst, total), the one with the largest total; ties by name."""
    x = F.col(value)
    sums = folds.groupBy(config).agg(F.sum(x).alias("total"), F.count_if(x > 0).alias("good"), F.min(x).alias("worst"))
    for gate in gates:
        sums = sums.where(gate)
    return sums.orderBy(F.desc("total"), config).limit(1).select(config, "total")


def same_density(rows: DataFrame, by: str, order: Column, key: str, zero: Column, half: Column) -> DataFrame:
    """`weight`: per group the first rows by `order` (numeric, smallest first) get 0 and the next 0.5, as many as meet the conditions `zero` and `half`; the rest 1."""
    b, z, h, place = (free(n, rows) for n in ("dense_by", "dense_z", "dense_h", "dense_i"))
    per = rows.groupBy(F.col(by).alias(b)).agg(F.count_if(zero).alias(z), F.count_if(half).alias(h))
    x = ranked(rows, [by], order, [key], place).join(per, F.col(by).eqNullSafe(F.col(b)))
    i = F.col(place)
    return x.select(*rows.columns, F.when(i <= F.col(z), 0.0).when(i <= F.col(z) + F.col(h), 0.5).otherwise(1.0).alias("weight"))
