"""A batch sink that is resumed where it stopped: a header that fixes the contract, and contiguous batches.

Rows are put into batches of consecutive keys. A batch is one Spark job whose folder counts only once Spark has marked it as complete, so a job that dies leaves nothing behind that counts.
On resuming, the header must be the same, complete batches must follow each other from the first, and each must hold the keys that the source has in its place.

Cases: an empty source has a header and no batch; rows with a null key have no place and are refused; repeated keys are rows of their own; other columns may have any name but `batch`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.timeline import running_before


def placed(source: DataFrame, key: str, rows: int, bucket: int = 65_536) -> DataFrame:
    """`source` with `batch`: rows in order of their (whole) key, `rows` a batch. Places are counted by ranges of keys, so no task holds all rows."""
    x = source.select("*", F.lit(0).alias("batch_one"), F.floor(F.col(key) / bucket).alias("batch_range"))
    x = running_before(x, "batch_one", "batch_range", [key], {"batch_at": F.lit(1)})
    return x.withColumn("batch", F.floor(F.col("batch_at") / rows)).drop("batch_one", "batch_range", "batch_at")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete batches."""
    system, place = _files(spark, folder)
    found = [str(s.getPath().getName()) for s in system.listStatus(place)] if system.exists(place) else []
    numbers = sorted(int(name.split("=")[1]) for name in found if name.startswith("number="))
    return [i for i in numbers if system.exists(_files(spark, f"{folder}/number={i}/_SUCCESS")[1])]


def _keys(rows: DataFrame, key: str, by: Column) -> dict[int, tuple[int, int]]:
    """Per batch: number of rows and a digest of their keys; one row a batch reaches the driver."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy(by.alias("b")).agg(F.count(F.lit(1)), F.sum(F.xxhash64(key).cast("decimal(38,0)"))).collect()}


def run(source: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], folder: str, header: dict, rows: int, most: int | None = None) -> DataFrame:
    """The results of `make` on each batch (they must keep the key), read from all complete batches. `most`: batches to do now; the rest is left for the next call."""
    spark = source.sparkSession
    if source.where(F.col(key).isNull()).limit(1).count():
        raise ValueError("a row without a key has no place")
    written = json.dumps(header, sort_keys=True)
    system, place = _files(spark, folder + "/header")
    if system.exists(place) and system.exists(_files(spark, folder + "/header/_SUCCESS")[1]):
        if spark.read.text(folder + "/header").first()[0] != written:
            raise ValueError("the header differs from that of the batches already there")
    else:
        spark.createDataFrame([(written,)], "value string").coalesce(1).write.mode("overwrite").text(folder + "/header")
    done = complete(spark, folder)
    if done != list(range(len(done))):
        raise ValueError("complete batches do not follow each other")
    whole = placed(source, key, rows)
    there = _keys(whole, key, F.col("batch"))
    if done:
        had = _keys(spark.read.parquet(*(f"{folder}/number={i}" for i in done)), key, F.col("batch"))
        if any(had.get(i) != there.get(i) for i in done):
            raise ValueError("a complete batch does not hold the rows that the source has in its place")
    todo = [i for i in sorted(there) if i >= len(done)][:most]
    for i in todo:
        make(whole.where(F.col("batch") == i)).withColumn("batch", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{folder}/number={i}")
    done += todo
    if not done:
        return make(whole.limit(0)).withColumn("batch", F.lit(0).cast("long"))
    return spark.read.parquet(*(f"{folder}/number={i}" for i in done))
