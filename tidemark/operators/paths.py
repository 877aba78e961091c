"""Drawdown of resampled paths, from summaries that merge.

A piece of a path is summed up by its total, its highest and lowest prefix and its largest fall. Two pieces merge: totals add, prefixes of the second start from the first's total, and the largest
fall is one of either or from the first's highest to the second's lowest prefix. So a path of blocks needs one row a block, whatever the block's length, and a long path is cut into blocks that meet in
different tasks. Draws are exact: as many picks as rows, each of any row with equal chance, told by 48 bits of MD5 over seed and number, so that SQL can draw the same ones.

Cases: an empty table gives no draw; null values count as 0 in a path; rows with a null order or key stand first; repeated keys are rows of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.timeline import running_before
from tidemark.sources.readers import written


def block_summaries(steps: DataFrame, n: int, lengths: list[int]) -> DataFrame:
    """For each start 0 to n - 1 of a circle of `steps` (i, x) and each length: total, high, low and fall of log(1 + x) along the block, and sum, squares and count of x."""
    longest = max(lengths)
    rows = steps.select("x", F.explode(F.expr(f"transform(sequence(0, {longest - 1}), o -> named_struct('o', o, 'start', pmod(i - o, {n})))")).alias("at")).select("x", "at.o", "at.start")
    w = Window.partitionBy("start").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("log", F.sum(F.log1p("x")).over(w)).withColumn("peak", F.greatest(F.max("log").over(w), F.lit(0.0)))
    found = None
    for length in sorted(set(lengths)):
        part = rows.where(F.col("o") < length).groupBy("start").agg(
            F.sum(F.log1p("x")).alias("total"), F.greatest(F.max("log"), F.lit(0.0)).alias("high"), F.least(F.min("log"), F.lit(0.0)).alias("low"), F.max(F.col("peak") - F.col("log")).alias("fall"), F.sum("x").alias("s"),
            F.sum(F.col("x") * F.col("x")).alias("q"), F.count("x").alias("c"),
        )
        part = part.withColumn("length", F.lit(length))
        found = part if found is None else found.unionByName(part)
    return found


def merged(pieces: DataFrame, by: str, order: str) -> DataFrame:
    """by, total and fall of the paths that pieces (by, order, total, high, low, fall, s, q, c) make in their order, and the sums of s, q and c."""
    earlier = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = pieces.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    x = x.withColumn("peak", F.greatest(F.max(F.col("before") + F.col("high")).over(earlier), F.lit(0.0)))
    worst = F.greatest("fall", F.col("peak") - F.col("before") - F.col("low"))
    return x.groupBy(by).agg(F.sum("total").alias("total"), F.max(worst).alias("fall"), *(F.sum(c).alias(c) for c in "sqc"))


def path_bootstrap(returns: DataFrame, order: str, r: str, block: int, draws: int, starts) -> DataFrame:
    """draw, mean, sharpe (not annualised), growth, total, drawdown of circular blocks of one row a day put end to end. `starts(draws, k, n)`: draw, j, pick of the k blocks of each draw.

    `growth` is the log of the total; the total itself (less one) is infinite where that is above 709.
    """
    n = returns.count()
    if not n:
        return returns.sparkSession.createDataFrame([], "draw long, mean double, sharpe double, growth double, total double, drawdown double")
    k = -(-n // block)
    rest = n - (k - 1) * block
    steps = returns.select(F.coalesce(F.col(r), F.lit(0.0)).alias("x"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).alias("i"))
    drawn = starts(draws, k, n).withColumn("length", F.when(F.col("j") == k - 1, rest).otherwise(block))
    pieces = drawn.withColumnRenamed("pick", "start").join(block_summaries(steps, n, [block, rest]), ["start", "length"])
    found = merged(pieces, "draw", "j")
    mean = F.col("s") / F.col("c")
    spread = F.sqrt(F.greatest(F.try_divide(F.col("q") - F.col("s") * mean, F.col("c") - 1), F.lit(0.0)))
    return found.select("draw", mean.alias("mean"), F.try_divide(mean, spread).alias("sharpe"), F.col("total").alias("growth"), F.expm1("total").alias("total"), (1 - F.exp(-F.col("fall"))).alias("drawdown"))


def _draw(n: int, parts: int, length: int, seed: int, size: int):
    """For each part of a draw (chunk: its number over all draws) a row for each bucket of trades that it draws from: the picks there as places in the bucket, and their places in the part."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeded = hashlib.md5(f"{seed}:".encode())

        def digest(number: int) -> bytes:
            h = seeded.copy()
            h.update(b"%d" % number)
            return h.digest()[:8]

        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                draw, part = divmod(chunk, parts)
                first, last = draw * n + part * length, draw * n + min(n, (part + 1) * length)
                pick = (np.frombuffer(b"".join(map(digest, range(first, last))), ">u8") >> np.uint64(16)).astype(np.int64) % n
                bucket = pick // size
                order = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
                cut = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
                at, place = order.astype("<u4"), (pick - bucket * size)[order].astype("<u2")
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[order[ends - 1]]), "chunk": pa.array(np.full(len(cut), chunk)), "at": pa.array([at[i:j].tobytes() for i, j in cut], pa.binary()), "place": pa.array([place[i:j].tobytes() for i, j in cut], pa.binary()),
                })

    return run


def _look_up(size: int):
    """The values of a bucket's trades at the places that the parts ask for."""
    import pyarrow as pa

    def run(trades: pa.Table, asked: pa.Table) -> pa.Table:
        x = np.zeros(size)
        x[trades["i"].to_numpy() % size] = trades["x"].to_numpy()
        values = [x[np.frombuffer(p, "<u2")].tobytes() for p in asked["place"].to_pylist()]
        return pa.table({"chunk": asked["chunk"], "at": asked["at"], "x": pa.array(values, pa.binary())})

    return run


def _summed(pieces):
    """One row a part: count, total, squares about its mean, gains, losses, highest prefix, and the falls in it (`tops`, `lows`) that can be a path's largest.

    A fall is told by the highest prefix before it and the prefix at its end. One that is no deeper than an earlier one, from a peak at least as high, is a smaller share of any (positive) equity.
    """
    import pyarrow as pa

    at = [np.frombuffer(a, "<u4") for a in pieces["at"].to_pylist()]
    x = np.zeros(sum(map(len, at)))
    for a, v in zip(at, pieces["x"].to_pylist()):
        x[a] = np.frombuffer(v, "<f8")
    run = np.cumsum(x)
    top = np.maximum.accumulate(run)
    depth = top - run
    deeper = np.flatnonzero(depth > np.concatenate(([-1.0], np.maximum.accumulate(depth)[:-1])))
    deeper = deeper[np.diff(top[deeper], append=np.inf) > 0]
    row = {"chunk": pieces["chunk"][0].as_py(), "c": len(x), "total": float(run[-1]), "q": float(np.square(x - x.mean()).sum()), "win": float(x[x > 0].sum()), "loss": float(-x[x < 0].sum()), "high": float(top[-1]), "tops": top[deeper].tolist(), "lows": run[deeper].tolist()}
    return pa.Table.from_pylist([row])


def trade_draws(trades: DataFrame, key: str, value: str, draws: int, seed: int, initial: float, block: int = 4096, length: int = 1 << 18) -> DataFrame:
    """draw, mean, sharpe, profit_factor, drawdown of as many trades as there are, drawn with replacement, on the equity that starts at `initial` (above 0).

    `key`: a whole number, by which trades are numbered in blocks of `block`. A draw's path is cut into parts of `length` picks. A part's picks go to the buckets of trades as packed arrays and their values come
    back as such, so a pick costs some twenty bytes of shuffle and no row; a part is then summed up by one row. No task holds a path or all trades.
    """
    if initial <= 0:
        raise ValueError("initial must be above 0")
    spark = trades.sparkSession
    t = trades.select(F.lit(0).alias("one"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))
    t = written(t.withColumn("bucket", F.floor(F.col("key") / block)), "trades")  # counted, numbered and looked up
    n = t.count()
    if not n:
        return spark.createDataFrame([], "draw long, mean double, sharpe double, profit_factor double, drawdown double")
    size = max(1, min(1 << 16, (1 << 21) // draws))  # places fit two bytes, and a bucket is asked for some two million picks
    parts = -(-n // length)
    numbered = running_before(t, "one", "bucket", ["key", "x"], {"i": F.lit(1)}).select(F.expr(f"i div {size}").alias("bucket"), "i", "x")
    asked = spark.range(0, draws * parts, 1, min(draws * parts, 1024)).mapInArrow(_draw(n, parts, length, seed, size), "bucket long, chunk long, at binary, place binary")
    values = numbered.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_look_up(size), "chunk long, at binary, x binary")
    found = values.groupBy("chunk").applyInArrow(_summed, "chunk long, c long, total double, q double, win double, loss double, high double, tops array<double>, lows array<double>")
    p = found.select(F.expr(f"chunk div {parts}").alias("draw"), F.expr(f"chunk % {parts}").alias("part"), "c", "total", "q", "win", "loss", "high", "tops", "lows")
    whole = Window.partitionBy("draw")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)) + initial).withColumn("mean", F.sum("total").over(whole) / F.sum("c").over(whole))
    p = p.withColumn("peak", F.greatest(F.max(F.col("before") + F.col("high")).over(earlier), F.lit(float(initial))))
    shares = F.zip_with("tops", "lows", lambda top, low: 1 - (F.col("before") + low) / F.greatest("peak", F.col("before") + top))
    spread = F.sqrt(F.sum(F.col("q") + F.col("c") * F.pow(F.col("total") / F.col("c") - F.col("mean"), F.lit(2.0))) / F.sum("c"))
    out = p.withColumn("fall", F.array_max(shares)).groupBy("draw", "mean").agg(spread.alias("spread"), F.sum("win").alias("win"), F.sum("loss").alias("loss"), F.max("fall").alias("drawdown"))
    return out.select("draw", "mean", F.try_divide("mean", "spread").alias("sharpe"), F.try_divide("win", "loss").alias("profit_factor"), "drawdown")


def intervals(draws: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, low, middle, high (95 %) over the draws."""
    each = draws.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("m")).select("m.*")
    return each.groupBy("metric").agg(*(F.percentile("v", q).alias(n) for n, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))))
