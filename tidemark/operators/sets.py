"""Set operations on tables that share a key.

Cases: null keys are a key like any other; of rows that repeat a key within one page any one stays; an empty page adds nothing; `__page` and `__row` are names of the operator's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write(pages: list[DataFrame], key: list[str]) -> DataFrame:
    """Overlapping pages as one table: of rows with the same key, the one of the latest page; a page holds a key once."""
    stacked = reduce(DataFrame.unionByName, (p.withColumn("__page", F.lit(i)) for i, p in enumerate(pages)))
    rest = [c for c in pages[0].columns if c not in key]
    last = stacked.groupBy(*key).agg(F.max_by(F.struct(*rest), "__page").alias("__row"))
    return last.select(*key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def of_both(rows: DataFrame, key: str, member: Column, other: Column) -> DataFrame:
    """Distinct keys that have a row of either kind each."""
    return rows.where(member).select(key).intersect(rows.where(other).select(key))
