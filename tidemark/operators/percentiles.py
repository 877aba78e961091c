"""Exact percentiles of groups of any size.

`percentile` holds every distinct value of a group in one buffer. Here a mergeable sketch (one pass, a few thousand entries a group) brackets each percentile by two values between which at most a few
parts in `accuracy` of the group's rows lie; a second pass counts what is below the bracket and keeps the distinct values inside it, and the running count of these gives the two order statistics to
interpolate. The result is the same double that `percentile` gives.

Cases: null values count for nothing, and a group without any other has null percentiles; not-a-number is the largest value; ties and repeated rows count each; a null key is a group of its own;
an empty table gives an empty result; other columns may have any name. The rows are read twice: write them first where they are costly to make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranks by which a sketch of this accuracy may err, in parts of the group.
ERRORS = 3


def exact_percentiles(rows: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """keys, n (values that are not null) and a double for each name of `shares` (0 to 1), interpolated between the neighbouring values. `value` is compared as a double."""
    if not all(0 <= q <= 1 for q in shares.values()):
        raise ValueError("shares are from 0 to 1")
    x = F.col(value) if isinstance(value, str) else value
    own = [f"k{i}" for i in range(len(keys))]
    plain = rows.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)), x.cast("double").alias("v"))
    margin = ERRORS / accuracy
    edges = sorted({min(1.0, max(0.0, q + side)) for q in shares.values() for side in (-margin, margin)})
    finite = F.when(~F.isnan("v"), F.col("v"))
    sketch = plain.groupBy(*own).agg(F.count("v").alias("n"), F.count(finite).alias("numbers"), F.percentile_approx(finite, edges, accuracy).alias("edge"))
    # The sketch is of the numbers alone; a place behind them is a not-a-number, and needs no bracket.
    brackets = sketch.withColumns({f"p{i}": (F.col("n") - 1) * F.lit(float(q)) for i, q in enumerate(shares.values())})
    cut = {i: _bracket(i, q, margin, edges) for i, q in enumerate(shares.values())}
    found = brackets.select(*own, "n", "numbers", *(f"p{i}" for i in cut), *(F.struct(low.alias("low"), high.alias("high")).alias(f"b{i}") for i, (low, high) in cut.items()))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in own]
    joined = plain.where("v is not null and not isnan(v)").alias("a")
    joined = joined.join(found.alias("f"), same) if own else joined.crossJoin(F.broadcast(found).alias("f"))  # one row without keys
    v = F.col("a.v")
    part = lambda i: F.when(v < F.col(f"f.b{i}.low"), F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v"))).when(v <= F.col(f"f.b{i}.high"), F.struct(F.lit(i).alias("i"), v.alias("v")))
    met = joined.select(*(F.col(f"a.{k}") for k in own), F.explode(F.array_compact(F.array(*map(part, cut)))).alias("part"))
    counts = met.groupBy(*own, "part.i", "part.v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*own, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("c").over(w)).alias("a")
    upto = upto.join(found.alias("f"), same) if own else upto.crossJoin(F.broadcast(found).alias("f"))
    p = F.element_at(F.array(*(F.col(f"f.p{i}") for i in cut)), F.col("a.i") + 1)
    upto = upto.select(*(F.col(f"a.{k}") for k in own), "a.i", "a.v", "upto", p.alias("p"))
    reached = upto.groupBy(*own, "i").agg(
        F.min_by(F.struct("v"), F.when(F.col("upto") > F.floor("p"), F.col("upto"))).alias("lower"), F.min_by(F.struct("v"), F.when(F.col("upto") > F.ceil("p"), F.col("upto"))).alias("upper")
    )
    wide = reached.groupBy(*own).agg(*(F.max(F.when(F.col("i") == i, F.struct("lower", "upper"))).alias(f"r{i}") for i in cut)).alias("r")
    out = found.alias("f").join(wide, [F.col(f"f.{k}").eqNullSafe(F.col(f"r.{k}")) for k in own] or F.lit(True), "left")
    return out.select(*(F.col(f"f.{o}").alias(k) for k, o in zip(keys, own, strict=True)), F.col("f.n").alias("n"), *(_between(i).alias(name) for i, name in enumerate(shares)))


def _bracket(i: int, q: float, margin: float, edges: list[float]) -> tuple[Column, Column]:
    """Values that the two order statistics lie between. They are places among all values, so those behind the numbers widen the bracket to its end."""
    place = F.col(f"p{i}")
    low, high = (F.element_at("edge", edges.index(min(1.0, max(0.0, q + side))) + 1) for side in (-margin, margin))
    few = F.col("n") <= int(1 / margin)  # a bracket of less than a row: take all
    all_numbers = F.col("numbers") == F.col("n")
    least, most = F.lit(float("-inf")), F.lit(float("inf"))
    return F.when(few | ~all_numbers | place.isNull(), least).otherwise(low), F.when(few | ~all_numbers | place.isNull(), most).otherwise(high)


def _between(i: int) -> Column:
    place, numbers = F.col(f"f.p{i}"), F.col("f.numbers")
    low, high = F.floor(place), F.ceil(place)

    def at(rank: Column, side: str) -> Column:
        reached = F.col(f"r.r{i}.{side}.v")
        lost = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
        return F.when(rank >= numbers, F.lit(float("nan"))).when(reached.isNull(), lost).otherwise(reached)

    a, b = at(low, "lower"), at(high, "upper")
    return F.when(F.col("f.n") > 0, F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b))
