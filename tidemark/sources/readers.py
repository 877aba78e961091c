"""Readers and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.names import free


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, symbol_pattern: str = r"([^/_]+)_\d+_\d+\.json$", whole: bool = True) -> DataFrame:
    """Files of JSON arrays [ts_ms, open, high, low, close, volume, turnover]; the symbol is in the file name. `whole`: a file is one array, else each line."""
    raw = spark.read.text(path, wholetext=whole).select(F.regexp_extract(F.col("_metadata.file_path"), symbol_pattern, 1).alias("symbol"), F.explode(F.from_json("value", "array<array<double>>")).alias("x"))
    names = ["open", "high", "low", "close", "volume", "turnover"]
    return raw.select("symbol", F.col("x")[0].cast("long").alias("ts_ms"), *(F.col("x")[i + 1].alias(n) for i, n in enumerate(names)))


def newest_files(files: DataFrame, key: Column, time: Column) -> DataFrame:
    """The newest file of each key; ties to the path that sorts last."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(time.desc(), F.col("path").desc()))
    n = free("newest_place", files)
    return files.withColumn(n, rank).where(F.col(n) == 1).drop(n)


def read_series_map(spark: SparkSession, path: str, key_pattern: str, whole: bool = True) -> DataFrame:
    """Files of JSON objects {ts: value}: key (from the file name), ts, value."""
    raw = spark.read.text(path, wholetext=whole).select(F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1).alias("key"), F.explode(F.from_json("value", "map<string,double>")).alias("ts", "value"))
    return raw.withColumn("ts", F.col("ts").cast("long"))


def read_membership(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """JSON object {day: [symbols]}: day, symbol."""
    raw = spark.read.text(path, wholetext=whole).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("day", "symbols"))
    return raw.select(F.col("day").cast("long").alias("day"), F.explode("symbols").alias("symbol"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, compressed or not, with a fixed schema."""
    return spark.read.schema(schema).json(path)


def read_nested(spark: SparkSession, path: str, key: str, field: str, schema: str) -> DataFrame:
    """JSON results with an array of structs: the key and one row for each element."""
    rows = spark.read.schema(f"{key} string, {field} array<struct<{schema.replace(' ', ': ').replace(',:', ',')}>>").json(path)
    return rows.select(key, F.explode(field).alias("__x")).select(key, "__x.*")


def read_csv(spark: SparkSession, path: str, required: list[str], forbidden: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """Only the required columns of a quoted file with a header; fails if one is missing. Forbidden ones (outcomes) are never selected."""
    if set(required) & set(forbidden):
        raise ValueError("a required column is forbidden")
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*required)


def read_exact(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Text columns of separated files whose headers are exactly `columns`, in order; reading a file with another header fails."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, multiLine=True, escape='"', sep=sep)


def read_archives(spark: SparkSession, path: str, checksums: DataFrame, columns: int) -> tuple[DataFrame, DataFrame]:
    """Zip archives of one CSV file each, held against `checksums` (name, sha256): rows (name, fields array<string>) of the good ones, and the others (name, reason).

    Reasons: unlisted (no checksum), missing (no archive), checksum, members (not one file of the archive's name), columns (a row of another width, or none). Only archives that
    pass are unpacked, one at a time in a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("name"), "content", F.sha2("content", 256).alias("found"))
    held = files.join(checksums.select(F.col("name").alias("listed"), F.col("sha256").alias("wanted")), F.col("name") == F.col("listed"), "left")
    reason = F.when(F.col("wanted").isNull(), "unlisted").when(F.col("wanted") != F.col("found"), "checksum")
    held = held.withColumn("reason", reason)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io
        import zipfile

        for b in batches:
            for name, content in zip(b["name"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if z.namelist() != [name + ".csv"]:
                        yield pd.DataFrame({"name": [name], "fields": [None], "reason": ["members"]})
                        continue
                    rows = list(csv.reader(io.StringIO(z.read(name + ".csv").decode("utf-8-sig"))))
                if not rows or any(len(r) != columns for r in rows):
                    yield pd.DataFrame({"name": [name], "fields": [None], "reason": ["columns"]})
                else:
                    yield pd.DataFrame({"name": name, "fields": rows, "reason": None})

    opened = held.where("reason is null").select("name", "content").mapInPandas(unpack, "name string, fields array<string>, reason string")
    absent = checksums.select("name").join(files.select("name"), "name", "left_anti").select("name", F.lit("missing").alias("reason"))
    bad = held.where("reason is not null").select("name", "reason").unionByName(opened.where("reason is not null").select("name", "reason")).unionByName(absent)
    return opened.where("reason is null").select("name", "fields"), bad


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """`item` elements of feeds: title, link, pubDate, guid."""
    fields = "title string, link string, pubDate string, guid string"
    return spark.read.format("xml").option("rowTag", "item").schema(fields).load(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of `expected` (path, bytes, sha256) that fail: path and reason (missing, size, hash), and files nobody expected (extra)."""
    f = found.select("path", F.col("bytes").alias("f_bytes"), F.col("sha256").alias("f_sha"))
    both = expected.join(f, "path", "full")
    reason = F.when(F.col("f_sha").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("bytes") != F.col("f_bytes"), "size").when(F.col("sha256") != F.col("f_sha"), "hash")
    return both.select("path", reason.alias("reason")).where("reason is not null")


def write_table(df: DataFrame, path: str) -> None:
    """A whole table or none: Spark's commit protocol."""
    df.write.mode("overwrite").parquet(path)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet, for a resumable batch sink."""
    return rows.join(done.select(key), key, "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    """A small status table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a folder of its own, remembered in the session; a cluster is an error, as its executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_status(df: DataFrame, path: str, order: str) -> None:
    """A small status table as one Markdown file, its rows by `order`."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + " - |" * len(df.columns))], "part int, value string").withColumn("by", F.lit(None).cast("string"))
    body = df.select(F.lit(2).alias("part"), line([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"), F.col(order).cast("string").alias("by"))
    head.unionByName(body).repartition(1).sortWithinPartitions("part", "by").select("value").write.mode("overwrite").text(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back, so that whoever reads it sees the same rows, whatever tasks run again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
