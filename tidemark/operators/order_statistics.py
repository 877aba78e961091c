"""Ranks within sliding intervals in n log n.

Time is cut into buckets as wide as the interval; the rows of a bucket and of the one before it, which are all that its intervals reach, meet in one task as Arrow columns. There a wavelet matrix over the
ranks of their values counts, for all rows of the bucket together, how many values in a range of rows are smaller: one pass for each bit of a rank, whatever the interval holds.

Cases: rows with a null key or time, and null values, count for nothing and get null; not-a-number counts as the largest value, as Spark orders it; rows tied on time do not see each other;
an empty table gives an empty one; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import free


def smaller_in_ranges(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (low, high, asked): how many of ranks[low:high] are smaller than asked, and how many equal it. Ranks are whole numbers from 0."""
    ranks, low, high = ranks.copy(), low.copy(), high.copy()
    smaller = np.zeros(len(low), np.int64)
    for bit in reversed(range(max(1, int(max(ranks.max(initial=0), asked.max(initial=0))).bit_length()))):
        ones = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~ones)))
        z_low, z_high, up = zeros[low], zeros[high], (asked >> bit & 1).astype(bool)
        smaller += np.where(up, z_high - z_low, 0)
        low = np.where(up, zeros[-1] + low - z_low, z_low)
        high = np.where(up, zeros[-1] + high - z_high, z_high)
        ranks = np.concatenate((ranks[~ones], ranks[ones]))
    return smaller, high - low


def trailing_percentile(rows: DataFrame, key: str, time: str, value: str, span: int, least: int, out: str) -> DataFrame:
    """`rows` with `out`: the share of the values of the key at times [t - span, t) that are greater than the row's, ties counting half; null below `least` values."""
    x = rows.select(F.col(key).alias("k"), F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("x")).where("k is not null and t is not null and x is not null")
    b = F.floor(F.col("t") / span)
    near = x.select("k", "t", "x", F.explode(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b + 1).alias("b"), F.lit(False).alias("own")))).alias("p")).select("k", "p.b", "t", "x", "p.own")
    kind = next(f.dataType.simpleString() for f in x.schema.fields if f.name == "k")

    def ranked(table: pa.Table) -> pa.Table:
        t, v, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("t", "x", "own"))
        order = np.argsort(t, kind="stable")
        t, v, own = t[order], v[order], own[order].astype(bool)
        _, rank = np.unique(v, return_inverse=True)  # not-a-numbers are one value, the largest
        at = np.flatnonzero(own)
        at = at[np.unique(np.stack((t[at], rank[at])), axis=1, return_index=True)[1]] if len(at) else at  # one answer for each time and value
        low, high = np.searchsorted(t, t[at] - span), np.searchsorted(t, t[at])
        smaller, equal = smaller_in_ranges(rank.astype(np.int64), low, high, rank[at].astype(np.int64))
        n = high - low
        share = np.where(n >= least, (n - smaller - equal / 2) / np.maximum(n, 1), np.nan)
        return pa.table({"k": table.column("k").take(pa.array(np.zeros(len(at), np.int64))), "t": t[at], "x": v[at], "share": pa.array(share, from_pandas=True)})

    found = near.groupBy("k", "b").applyInArrow(ranked, f"k {kind}, t long, x double, share double")
    names = [free(f"percentile_{c}", rows) for c in ("k", "t", "x", "share")]
    found = found.toDF(*names)
    joined = rows.join(found, (F.col(key) == F.col(names[0])) & (F.col(time) == F.col(names[1])) & (F.col(value).cast("double") == F.col(names[2])), "left")
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), F.col(names[3]).alias(out))
