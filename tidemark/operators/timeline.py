"""Point-in-time joins: no row sees information that becomes available after it.

Times are integers. Rows of a key meet in buckets of time, never all in one task, and hand what later buckets need on by one row a bucket, so a key that fills the table is no hot group.
What meets in a bucket has one row for each distinct time, so a bucket is bounded by its width, not by the data.

Cases: a row with a null key or a null time on the left has no match (null values, count 0); on the right it is no match for any; repeated left rows each get the answer;
right rows tied on time are named below; an empty side gives no matches; columns other than those named may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import free
from tidemark.operators.sliding import interval_aggregates

BUCKET = 86_400


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], bucket: int = BUCKET) -> DataFrame:
    """For each left row the `values` of the latest right row of its key at or before its `time` (null if none). Right rows tied on time: the last by all values.

    Distinct times of a key and bucket of both sides share one window; the last right row of each bucket is carried to the buckets up to the next one that has any.
    """
    k, t = F.col(key).alias("k"), F.col(time).cast("long").alias("t")
    r = right.select(k, t, F.struct(*values).alias("v")).where("k is not null and t is not null").groupBy("k", "t").agg(F.max("v").alias("v"))
    l = left.select(k, t).where("k is not null and t is not null").distinct().select("k", "t", F.lit(None).cast(r.schema["v"].dataType).alias("v"), F.lit(True).alias("asks"))  # noqa: E741
    b = F.floor(F.col("t") / bucket).alias("b")
    both = r.withColumn("asks", F.lit(False)).unionByName(l).select("k", "t", "v", "asks", b)
    near = both.withColumn("v", F.last("v", ignorenulls=True).over(Window.partitionBy("k", "b").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0))).where("asks")
    ends = r.select("k", "v", "t", b).groupBy("k", "b").agg(F.max_by("v", "t").alias("v")).withColumn("asks", F.lit(False))
    wanted = l.select("k", b).distinct().withColumn("v", F.lit(None).cast(r.schema["v"].dataType)).withColumn("asks", F.lit(True))
    before = Window.partitionBy("k").orderBy("b", F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)  # a bucket asks before its own end counts; one row a bucket
    carried = ends.unionByName(wanted).withColumn("before", F.last("v", ignorenulls=True).over(before)).where("asks").select("k", "b", "before")
    found = near.join(carried, ["k", "b"]).select(F.col("k").alias("k_"), F.col("t").alias("t_"), F.coalesce("v", "before").alias("v"))
    names = {n: free(n, left) for n in ("asof_k", "asof_t", "asof_v")}
    found = found.toDF(*names.values())
    out = left.join(found, (F.col(key) == F.col(names["asof_k"])) & (F.col(time) == F.col(names["asof_t"])), "left")
    return out.select(*left.columns, *(F.col(f"{names['asof_v']}.{c}").alias(c) for c in values))


def interval_sum(left: DataFrame, right: DataFrame, key: str, time: str, value: str, length: int, closed: str, out: str) -> DataFrame:
    """For each left row the sum and count of right `value` over a trailing interval: "right" for (t - length, t], "left" for [t - length, t). Null sum, zero count where nothing falls in."""
    x = F.col(value).cast("double")
    return interval_aggregates(left, right, key, time, length, closed, {out: ("sum", x), out + "_n": ("count", x)})


def running_before(rows: DataFrame, key: str, bucket: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds, for each name in `values`, the sum of its expression over the rows of the key before this one, by `bucket` (such as a day), then `order`, which must end with a unique column; 0 before the first.

    Sums run over the buckets, one row each, and over the rows of one bucket; no task gets all rows of a key.
    """
    per = rows.groupBy(key, bucket).agg(*(F.sum(e).alias(n) for n, e in values.items()))
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    names = {n: free(f"before_{n}", rows) for n in values}
    offset = per.select(F.col(key).alias(free("before_k", rows)), F.col(bucket).alias(free("before_b", rows)), *(F.sum(n).over(earlier).alias(names[n]) for n in values))
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumns({n: F.coalesce(F.sum(e).over(within), F.lit(0)) for n, e in values.items()})
    x = x.join(offset, F.col(key).eqNullSafe(F.col(offset.columns[0])) & F.col(bucket).eqNullSafe(F.col(offset.columns[1])))
    kept = [F.col(c) for c in rows.columns if c not in values]
    return x.select(*kept, *((F.col(n) + F.coalesce(names[n], F.lit(0))).alias(n) for n in values))


def cluster_by_gap(rows: DataFrame, key: str, time: str, gap: int, bucket: int = BUCKET) -> DataFrame:
    """`cluster` numbers from 1 per key; a new one starts when the gap exceeds `gap`. Null where key or time is null."""
    t = rows.select(F.col(key).alias("k"), F.col(time).cast("long").alias("t")).where("k is not null and t is not null").distinct().withColumn("b", F.floor(F.col("t") / bucket))
    last = t.groupBy("k", "b").agg(F.max("t").alias("end"))
    last = last.select("k", "b", F.lag("end").over(Window.partitionBy("k").orderBy("b")).alias("end"))
    before = F.coalesce(F.lag("t").over(Window.partitionBy("k", "b").orderBy("t")), F.col("end"))
    t = t.join(last, ["k", "b"]).withColumn("before", before).withColumn("new", F.coalesce((F.col("t") - F.col("before") > gap).cast("int"), F.lit(1)))
    numbered = running_before(t, "k", "b", ["t"], {"earlier": F.col("new")})
    names = [free(n, rows) for n in ("gap_k", "gap_t")]
    found = numbered.select(F.col("k").alias(names[0]), F.col("t").alias(names[1]), (F.col("earlier") + F.col("new")).alias("cluster"))
    return rows.join(found, (F.col(key) == F.col(names[0])) & (F.col(time) == F.col(names[1])), "left").select(*rows.columns, "cluster")


def next_boundary(sec: Column, step: int, strict: bool = True) -> Column:
    """The next multiple of `step`: strictly after `sec`, or at or after it."""
    return F.floor(sec / step) * step + step if strict else F.ceil(sec / step) * step


def forward_return(events: DataFrame, bars: DataFrame, key: str, slot: str, delay: int, horizon: int) -> DataFrame:
    """Open at slot + delay + horizon over open at slot + delay, less 1; events without both bars are dropped."""
    first, last = free("forward_first", events), free("forward_last", events)
    a = bars.select(key, (F.col(slot) - delay).alias(slot), F.col("open").alias(first))
    b = bars.select(key, (F.col(slot) - delay - horizon).alias(slot), F.col("open").alias(last))
    return events.join(a, [key, slot]).join(b, [key, slot]).withColumn("forward", F.col(last) / F.col(first) - 1).drop(first, last)


def events_in_spans(spans: DataFrame, events: DataFrame, key: str, start: str, end: str, time: str, bucket: int) -> DataFrame:
    """Events with start < time < end of a span of the same key: spans are exploded over buckets, so the join is an equi join."""
    b = free("span_bucket", spans, events)
    s = spans.withColumn(b, F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    e = events.withColumn(b, F.floor(F.col(time) / bucket))
    return s.join(e, [key, b]).where((F.col(time) > F.col(start)) & (F.col(time) < F.col(end))).drop(b)


def following_sum(left: DataFrame, right: DataFrame, key: str, time: str, value: str, length: int, out: str) -> DataFrame:
    """For each distinct key and (integer) time of left the sum and count (`out`, `out`_n) of right `value` at times strictly between time and time + length; only where there are any.

    Right rows are summed by time first, and each time is put into its bucket of `length` and the one before, so that a bucket holds all that its spans reach. A span
    is the difference of the running sums at its last and first instant: no pairs are made, and a bucket has at most as many rows as times fit into it.
    """
    bucket = lambda t: F.floor(t / length)
    r = right.groupBy(key, F.col(time).alias("__t")).agg(F.sum(value).alias("__x"), F.count(value).alias("__n"))
    r = r.select(key, F.explode(F.array(bucket(F.col("__t")), bucket(F.col("__t")) - 1)).alias("__b"), "__t", "__x", "__n", F.lit(None).cast("long").alias("__start"), F.lit(0).alias("__sign"))
    l = left.select(key, F.col(time).cast("long").alias("__start")).where("__start is not null").distinct().withColumn("__b", bucket(F.col("__start")))  # noqa: E741
    probes = l.withColumn("__sign", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("__t", F.when(F.col("__sign") < 0, F.col("__start")).otherwise(F.col("__start") + length - 1))
    w = Window.partitionBy(key, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    run = r.unionByName(probes, allowMissingColumns=True).withColumns({"__x": F.coalesce(F.sum("__x").over(w), F.lit(0.0)), "__n": F.coalesce(F.sum("__n").over(w), F.lit(0))}).where("__sign <> 0")
    sums = run.groupBy(key, F.col("__start").alias(time)).agg(F.sum(F.col("__sign") * F.col("__x")).alias(out), F.sum(F.col("__sign") * F.col("__n")).alias(out + "_n"))
    return sums.where(F.col(out + "_n") > 0)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The inner join, and a one-row proof: keys missing on either side and keys held twice."""
    l, r = left.groupBy(key).agg(F.count(F.lit(1)).alias("a")), right.groupBy(key).agg(F.count(F.lit(1)).alias("b"))  # noqa: E741
    proof = l.join(r, key, "full").agg(
        F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if((F.coalesce("a", F.lit(0)) > 1) | (F.coalesce("b", F.lit(0)) > 1)).alias("twice")
    )
    return left.join(right, key), proof


def common_times(rows: DataFrame, key: str, time: str, keys: int) -> DataFrame:
    """Rows at the times that all `keys` keys have."""
    full = rows.groupBy(time).agg(F.countDistinct(key).alias("__n")).where(F.col("__n") == keys).select(time)
    return rows.join(full, time, "left_semi")


def tier_lookup(rows: DataFrame, tiers: DataFrame, amount: str) -> DataFrame:
    """`required` by the first tier (limit, rate, deduction) whose limit is at least the amount; null above the last. `tiers` is a small fixed table."""
    t = tiers.orderBy("limit").collect()
    required = F.lit(None).cast("double")
    for r in reversed(t):
        required = F.when(F.col(amount) <= r["limit"], F.col(amount) * r["rate"] - r["deduction"]).otherwise(required)
    return rows.withColumn("required", required)


def known_cases(rows: DataFrame, cases: DataFrame, key: str, day: str, known: str, scales: dict[str, float], lookback: int, k: int) -> DataFrame:
    """For each row the k nearest cases of its key of the last `lookback` days whose outcome was known by its day; distance: sum of scaled differences.

    A case is joined by equality to the days it can serve, so the work is rows times lookback at most. Ties go to the earlier case.
    """
    serves = cases.where(F.col(known) <= F.col(day) + lookback).withColumn("__day", F.explode(F.sequence(F.col(known), F.col(day) + lookback)))
    c = serves.select(F.col(key).alias("__key"), "__day", F.col(day).alias("__case"), "outcome", *(F.col(x).alias(f"__{x}") for x in scales))
    distance = sum((F.abs(F.col(x) - F.col(f"__{x}")) / s for x, s in scales.items()), F.lit(0.0))
    pairs = rows.drop("outcome").join(c, (F.col(key) == F.col("__key")) & (F.col(day) == F.col("__day"))).withColumn("distance", F.round(distance, 9))
    place = F.row_number().over(Window.partitionBy(key, day).orderBy("distance", "__case"))
    return pairs.withColumn("__i", place).where(F.col("__i") <= k).select(key, day, F.col("__case").alias("case_day"), "distance", "outcome")


def blend(curves: list[tuple[DataFrame, float]], time: str, value: str) -> DataFrame:
    """Weighted sum of a few series on the union of their times, each carried forward; times before the last one starts are dropped. One row a time, so the order is one window."""
    long = None
    for i, (curve, _) in enumerate(curves):
        part = curve.select(time, F.struct(F.lit(i).alias("i"), F.col(value).alias("v")).alias("__p"))
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy(time).agg(*(F.max(F.when(F.col("__p.i") == i, F.col("__p.v"))).alias(f"__v{i}") for i in range(len(curves))))
    w = Window.partitionBy(F.lit(0)).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    total = sum((weight * F.last(f"__v{i}", ignorenulls=True).over(w) for i, (_, weight) in enumerate(curves)), F.lit(0.0))
    return wide.select(time, total.alias("blend")).where("blend is not null")


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, left_time: str, right_id: str, right_time: str, tolerance: int) -> DataFrame:
    """For each left row the right row nearest in time (integers), at most `tolerance` away; ties to the smaller id.

    No pairs are made: distinct times of both sides go into buckets of a fixed width, a window in each finds the last right time before and the first after, and
    each bucket hands its first and last right time to the buckets within the tolerance. A bucket has at most as many rows as times fit into it.
    """
    step = max(1, tolerance // 32)
    reach = -(-tolerance // step)
    r = right.where(F.col(right_time).isNotNull()).select(F.col(right_time).cast("long").alias("__t"), F.col(right_id).alias("__id"), F.lit(True).alias("__right"))
    l = left.where(F.col(left_time).isNotNull()).select(F.col(left_time).cast("long").alias("__t"), F.lit(None).cast(r.schema["__id"].dataType).alias("__id"), F.lit(False).alias("__right"))  # noqa: E741
    times = r.unionByName(l).groupBy("__t").agg(F.min("__id").alias("__id"), F.max("__right").alias("__right"), F.min("__right").alias("__only"))
    times = times.select("__t", "__only", F.floor(F.col("__t") / step).alias("__b"), F.when(F.col("__right"), F.struct("__t", "__id")).alias("__r"))
    ends = times.groupBy("__b").agg(F.min("__r").alias("__first"), F.max("__r").alias("__last")).where("__first is not null")
    reached = ends.withColumn("__to", F.explode(F.expr(f"sequence(__b - {reach}, __b + {reach})")))
    carried = reached.groupBy(F.col("__to").alias("__b")).agg(F.max(F.when(F.col("__b") < F.col("__to"), F.col("__last"))).alias("__earlier"), F.min(F.when(F.col("__b") > F.col("__to"), F.col("__first"))).alias("__later"))
    w = Window.partitionBy("__b").orderBy("__t")
    near = times.withColumns({
        "__before": F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.first("__r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    }).where("not __only").join(carried, "__b", "left")
    found = [F.coalesce("__before", "__earlier"), F.coalesce("__after", "__later")]
    best = F.least(*(F.when(f.isNotNull(), F.struct(F.abs(f["__t"] - F.col("__t")).alias("distance"), f["__id"].alias(right_id))) for f in found))
    near = near.select(F.col("__t").alias("__at"), best.alias("__m")).where(F.col("__m.distance") <= tolerance)
    return left.join(near, F.col(left_time) == F.col("__at")).select(left_id, F.col(f"__m.{right_id}").alias(right_id), F.col("__m.distance").alias("distance"))


def differing(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose rows differ (a row missing on one side differs in every field that is not null), and the fields."""
    both = a.select(key, F.struct(*fields).alias("__a")).join(b.select(key, F.struct(*fields).alias("__b")), key, "full")
    names = F.array_compact(F.array(*(F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), f) for f in fields)))
    return both.select(key, F.array_join(names, ",").alias("fields")).where("fields <> ''")
