"""Cleaning, deduplication, selection and profiling of text corpora, and features of the events read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import free

DAY = 86_400


def available(published: Column, date_only: Column) -> Column:
    """A date becomes available at the next midnight, a time at once (seconds)."""
    return F.when(date_only, F.floor(published / DAY) * DAY + DAY).otherwise(published)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails, null if none does. A rule holds where its condition is true."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules)))


def keep_first(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    n = free("first_place", rows)
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def normal_title(text: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def round_robin(rows: DataFrame, group: str, source: str, order: list[str], cap: int) -> DataFrame:
    """The n-th item of every source before the (n + 1)-th of any, up to `cap` a group; `place` is the position."""
    nth = free("nth", rows)
    first = rows.withColumn(nth, F.row_number().over(Window.partitionBy(group, source).orderBy(*order))).where(F.col(nth) <= cap)  # later ones can't be among the first `cap`
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(nth, source))).where(F.col("place") <= cap)
    return kept.withColumnRenamed(nth, "nth") if nth == "nth" else kept.drop(nth)


def diverse(rows: DataFrame, group: str, source: str, order: list[str], cap: int) -> DataFrame:
    """The best item of each source first, then the best of the rest, up to `cap` a group."""
    n = free("diverse_place", rows)
    nth = rows.withColumn(n, F.row_number().over(Window.partitionBy(group, source).orderBy(*order))).where(F.col(n) <= cap)  # later ones can't be among the first `cap`
    return nth.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(n) > 1, *order))).where(F.col("place") <= cap).drop(n)


def digest(value: str) -> Column:
    """SHA-256 of the sorted values of a group."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256)


def digest_of_ranges(rows: DataFrame, by: str, id_col: str, width: int) -> DataFrame:
    """by, digest, n: SHA-256 over the digests, in order, of each range of `width` integer ids, which is over its ids in order. A range holds `width` distinct ids at most, so no task gets a whole group."""
    of_range = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string")), "\n"), 256)
    inner = rows.groupBy(by, F.floor(F.col(id_col) / width).alias("digest_range")).agg(of_range.alias("d"), F.count(F.lit(1)).alias("n"))
    outer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("digest_range", "d"))), lambda x: x["d"]), "\n")
    return inner.groupBy(by).agg(F.sha2(outer, 256).alias("digest"), F.sum("n").alias("n"))


def merged(rows: DataFrame, by: str, text: str, order: str) -> DataFrame:
    """Documents of one time as one: text in order, number, digest."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(by).agg(parts.alias("__p")).select(by, F.array_join(F.col(f"__p.{text}"), "\n\n").alias("text"), F.size("__p").cast("long").alias("n")).withColumn("sha", F.sha2("text", 256))


def event_features(records: DataFrame, by: list[str], types: list[str]) -> DataFrame:
    """Per group: count, share of each event type, mean and largest severity, signed mean (direction 1 up, 2 down)."""
    sign = F.when(F.col("direction") == 1, 1).when(F.col("direction") == 2, -1).otherwise(0)
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(F.when(F.col("event_type") == t, 1.0).otherwise(0.0)).alias(f"share_{t}") for t in types),
        F.avg("severity").alias("mean_severity"), F.max("severity").alias("max_severity"), F.avg(sign * F.col("severity")).alias("signed"),
    )


def on_spine(features: DataFrame, day: str) -> DataFrame:
    """One row for every day from the first to the last; features of empty days are 0."""
    spine = features.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias(day))
    return spine.join(features, day, "left").fillna(0)


def strength() -> Column:
    return F.col("severity") * F.col("confidence") * (0.5 + 0.5 * F.col("surprise"))


def kth_source(rows: DataFrame, by: str, source: str, time: str, k: int) -> DataFrame:
    """When the k-th distinct source confirmed: the k-th smallest first time of a source."""
    first = rows.groupBy(by, source).agg(F.min(time).alias("first"))
    return first.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("first", source))).where(F.col("__n") == k).select(by, F.col("first").alias("confirmed"))


def novelty(rows: DataFrame, token: str, day: str, lookback: int) -> DataFrame:
    """Per day the distinct tokens, and how many of them no day of the lookback before it had (the day itself is left out)."""
    once = rows.select(day, token).distinct()
    before = F.lag(day).over(Window.partitionBy(token).orderBy(day))
    return once.withColumn("__new", F.coalesce((F.col(day) - before > lookback).cast("int"), F.lit(1))).groupBy(day).agg(F.count(F.lit(1)).alias("tokens"), F.sum("__new").alias("new"))


def first_of(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by `order`, which must end with a unique column. An aggregate: copies are combined before the shuffle, whatever their number."""
    rest = [c for c in rows.columns if c not in order]
    return rows.groupBy(key.alias("__k")).agg(F.min(F.struct(*order, *rest)).alias("__m")).select("__m.*")


def recurrence(rows: DataFrame, text: str, day: str, lookback: int) -> DataFrame:
    """Per day the number of texts, and of those that some day of the lookback before it had (the day itself is left out)."""
    once = rows.groupBy(text, day).agg(F.count(F.lit(1)).alias("__n"))
    before = F.lag(day).over(Window.partitionBy(text).orderBy(day))
    seen = F.coalesce(F.col(day) - before <= lookback, F.lit(False))
    return once.withColumn("__seen", F.when(seen, F.col("__n")).otherwise(0)).groupBy(day).agg(F.sum("__n").alias("texts"), F.sum("__seen").alias("recurring"))


def profile(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """Texts are told apart by a 128-bit digest, so that what the distinct counts multiply is narrow."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"([^ \t\n\r]+)")))
    return docs.select(id_col, F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), source, words.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("ids"), F.countDistinct("digest").alias("texts"), F.countDistinct(source).alias("sources"),
        F.percentile("w", 0.5).alias("p50"), F.percentile("w", 0.95).alias("p95"), F.count_if(F.col("w") >= 300).alias("long"),
    )


def guarded(features: DataFrame, prefix: str, banned: list[str], keys: list[str]) -> DataFrame:
    """The features themselves; fails if a name lacks the prefix or holds a banned word."""
    names = [c for c in features.columns if c not in keys]
    if bad := [c for c in names if not c.startswith(prefix) or any(b in c for b in banned)]:
        raise ValueError(f"features not allowed: {bad}")
    return features


def one_hot(rows: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """An indicator column for each level, and one for all other values (null among them)."""
    x = F.col(column)
    seen = {f"is_{level}": F.coalesce((x == level).cast("long"), F.lit(0).cast("long")) for level in levels}
    return rows.withColumns({**seen, "is_other": F.coalesce((~x.isin(*levels)).cast("long"), F.lit(1).cast("long"))})


def conditional_impact(records: DataFrame, by: list[str], types: list[str], weight: Column | None = None) -> DataFrame:
    """Mean of sign, severity, surprise, confidence and weight (1 if none) multiplied, for each event type; 0 when the group has none."""
    sign = F.when(F.col("direction") == 1, 1).when(F.col("direction") == 2, -1).otherwise(0)
    impact = sign * F.col("severity") * F.col("surprise") * F.col("confidence") * (F.lit(1.0) if weight is None else weight)
    return records.groupBy(*by).agg(*(F.coalesce(F.avg(F.when(F.col("event_type") == t, impact)), F.lit(0.0)).alias(f"impact_{t}") for t in types))


def assembled(chunks: DataFrame, key: str, position: str, chunk: str) -> DataFrame:
    """key, chunks, text: each distinct chunk of a key once, at its first position. A group is one document."""
    once = chunks.groupBy(key, chunk).agg(F.min(position).alias("__p"))
    parts = F.array_sort(F.collect_list(F.struct("__p", chunk)))
    return once.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.transform(parts, lambda x: x[chunk]), "\n").alias("text"))


def admitted(rows: DataFrame, reason: str, duplicates: list[tuple[str, str]], order: list[str]) -> DataFrame:
    """`rows` with the reason of those that had none and repeat a key: for each (name, key) in turn, of the rows that still have no reason, all but the first by `order` (which ends with a unique column) get the name.

    First rows come from an aggregate, so copies are combined before the shuffle; null keys repeat each other. A row dropped for a later key still holds its earlier one.
    """
    at = F.struct(*order)
    k, f = free("admit_key", rows), free("admit_first", rows)
    for name, key in duplicates:
        first = rows.where(F.col(reason).isNull()).groupBy(F.col(key).alias(k)).agg(F.min(at).alias(f))
        later = F.col(reason).isNull() & (at > F.col(f))
        rows = rows.join(first, F.col(key).eqNullSafe(F.col(k)), "left").withColumn(reason, F.when(later, name).otherwise(F.col(reason))).drop(k, f)
    return rows


def one_each(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """For each key and name whether its column has one value only (nulls don't count)."""
    return rows.groupBy(key).agg(*(F.coalesce(F.min(c) == F.max(c), F.lit(False)).alias(n) for n, c in columns.items()))


def full_profile(docs: DataFrame, id_col: str, published: str, title: str, url: str, source: str, body: str, words: str, levels: tuple[int, ...], bucket: int, top: int) -> DataFrame:
    """metric, value: counts, distinct ids, urls, titles, bodies and sources, span and years, percentiles and levels of word counts, sizes of time buckets and those of several sources, and the largest sources.

    `words` counts a body's words, `published` is seconds. Texts are told apart by 128-bit digests; rows without a time are in no bucket; empty titles and bodies aren't counted.
    """
    digest = lambda c: F.when(F.col(c) != "", F.unhex(F.md5(F.col(c).cast("binary"))))
    x = docs.select(F.col(id_col).alias("id"), F.col(published).alias("at"), digest(title).alias("title"), F.unhex(F.md5(F.col(url).cast("binary"))).alias("url"), F.col(source).alias("source"), digest(body).alias("body"), F.col(words).alias("w"))
    quantiles = (10, 25, 50, 75, 90)
    one = x.agg(
        F.count(F.lit(1)).alias("rows"), F.count("at").alias("valid_times"), *(F.countDistinct(c).alias(n) for c, n in (("id", "ids"), ("url", "urls"), ("title", "titles"), ("body", "bodies"), ("source", "sources"))),
        F.min("at").alias("first"), F.max("at").alias("last"), *(F.percentile("w", q / 100).alias(f"words_p{q}") for q in quantiles), *(F.count_if(F.col("w") >= k).alias(f"words_at_least_{k}") for k in levels),
    )
    timed = x.where(F.col("at").isNotNull())
    buckets = timed.groupBy(F.floor(F.col("at") / bucket).alias("bucket"), "source").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("source").alias("sources"))
    sizes = buckets.agg(F.count(F.lit(1)).alias("buckets"), F.count_if(F.col("sources") >= 2).alias("multi_source_buckets"), F.percentile("n", 0.5).alias("bucket_p50"), F.percentile("n", 0.9).alias("bucket_p90"), F.max("n").alias("bucket_max"))
    long = lambda row: row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))).alias("m")).select("m.*")
    years = timed.groupBy(F.concat(F.lit("year:"), F.year(F.timestamp_seconds("at"))).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    sources = x.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(top).select(F.concat(F.lit("source:"), "source").alias("metric"), F.col("n").cast("double").alias("value"))
    return long(one).unionByName(long(sizes)).unionByName(years).unionByName(sources)
