"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes that the Python workers of one executor may remember together (see `worker_bytes`).
EXECUTOR_CACHE = 320 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Where that is unset, a local session (as in tests) gets a folder of its own, remembered in the session; a cluster is an error, as its executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: later steps neither recompute it nor need the executors that made it."""
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`staged`, with the folder, for `discard`."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(docs: DataFrame, name: str) -> str:
    """`name`, or it with underscores behind it until no column of `docs` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """Every column of `docs`, whatever characters its name has."""
    return [named(c) for c in docs.columns]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def with_arrow_column(docs: DataFrame, source: str, make: Callable[[], Callable[[pa.Array], pa.Array]], out: str, kind: T.DataType, keep: bool = True) -> DataFrame:
    """`docs` with a last column `out` made from each Arrow batch of column `source` by what `make()` gives, once a task; without `source` on request.

    Columns travel by position, as `mapInArrow` can't find names with dots.
    """
    at = docs.columns.index(source)
    kept = [i for i in range(len(docs.columns)) if keep or i != at]
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = make()
        for batch in batches:
            yield pa.record_batch([*(batch.column(i) for i in kept), column(batch.column(at))], names=[*(batch.schema.names[i] for i in kept), "out"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    schema = T.StructType([*(numbered.schema.fields[i] for i in kept), T.StructField("out", kind)])
    return numbered.mapInArrow(of, schema).toDF(*(docs.columns[i] for i in kept), out)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets Arrow batches between the JVM and Python hold at most about `most` bytes in this session; a smaller setting stays.

    Both sides hold a batch outside of the heap, more than once while it grows and is copied, and keep that memory for the stages that follow.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(-?\d+)\s*([kmgtp]?)", spark.conf.get(key).lower()).groups()
    now = int(number) << 10 * " kmgtp".index(unit or " ")
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def id_bucket(column: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n: which rows a model may learn from. Null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def crc32_sql(column: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an integer as decimal text: two steps of four bits a byte, with the table of the reflected polynomial."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    digits = f"list_transform(string_split({column}::VARCHAR, ''), lambda d: [ascii(d) & 15, ascii(d) >> 4])"
    steps = f"list_reduce(list_concat([4294967295::BIGINT], flatten({digits})), lambda c, x: xor(c >> 4, ({table}::BIGINT[])[(xor(c, x) & 15) + 1]))"
    return f"(4294967295 - {steps})"


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and an executor's stages share its memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shards(total: int, per_shard: int) -> int:
    return max(1, -(-int(total) // per_shard))


def worker_bytes(spark: SparkSession, most: int = EXECUTOR_CACHE) -> int:
    """The share of `most` bytes of one Python worker: an executor has a worker for each of its cores."""
    master = spark.sparkContext.master
    cores = spark.conf.get("spark.executor.cores", None)
    if cores is None and master.startswith("local-cluster["):
        cores = master.split(",")[1]
    elif cores is None and master.startswith("local"):
        cores = spark.sparkContext.defaultParallelism
    return most // max(1, int(cores or 8))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, str]:
    """`rows` with `number` (from 0, by `order`, nulls first, within equal `group`, null too) and `size` (rows of the group), and the folder that they are read from.

    No group meets in one task: rows are dealt by ranges of group, order and place, so a group, or a tie, of any size takes as many partitions as it needs; a row
    then finds its number by its place in its partition and the rows of its group in the partitions before, one row for each group and partition.
    """
    place = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    by = place[group]
    plain = rows.toDF(*place.values()).withColumn("tie", F.monotonically_increasing_id())
    first, first_at = staged_at(plain, f"{name}-rows")
    keys = [by, *(place[c] for c in order), "tie"]
    dealt, path = staged_at(first.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()), name)
    discard(rows.sparkSession, first_at)
    part = F.shiftright("at", 33)
    parts = dealt.groupBy(F.col(by).alias("g"), part.alias("p")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(of_group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("g", "p", (before - F.col("first")).alias("shift"), F.sum("n").over(of_group).alias("all"))
    found = dealt.join(parts, F.col(by).eqNullSafe(F.col("g")) & (part == F.col("p")))
    return found.select(*(F.col(at).alias(c) for c, at in place.items()), (F.col("at") + F.col("shift")).alias("number"), F.col("all").alias("size")), path
