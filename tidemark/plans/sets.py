"""Queries over set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sets
from tidemark.plans.demo import BARS_1D, BARS_4H, bars_1d, bars_4h
from tidemark.plans.registry import query
from tidemark.sources.readers import table


@query(f"WITH {BARS_1D} SELECT day FROM b WHERE symbol = 'S0' AND turnover > 500000 INTERSECT SELECT day FROM b WHERE symbol = 'S1' AND turnover > 500000")
def st02_common_days(spark, d):
    """Days on which both symbols are traded actively."""
    active = F.col("turnover") > 500000
    return sets.of_both(bars_1d(spark, d), "day", active & (F.col("symbol") == "S0"), active & (F.col("symbol") == "S1"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def st03_unlabelled(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query(f"""WITH {BARS_1D} SELECT symbol, day, CASE WHEN day % 3 <> 0 THEN close * 2 ELSE close END AS close FROM b""")
def st04_last_write(spark, d):
    """A page of all days, then a corrected page of the days not divisible by three: the later one wins where they overlap."""
    b = bars_1d(spark, d).select("symbol", "day", "close")
    pages = [b, b.where("day % 3 <> 0").withColumn("close", F.col("close") * 2)]
    return sets.last_write(pages, ["symbol", "day"])


@query(f"WITH {BARS_1D}, {BARS_4H} SELECT day FROM b UNION SELECT slot // 6 AS day FROM b4")
def st05_all_days(spark, d):
    """Every day seen in either series of bars."""
    return bars_1d(spark, d).select("day").union(bars_4h(spark, d).select(F.expr("slot div 6").alias("day"))).distinct()
