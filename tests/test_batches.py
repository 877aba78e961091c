"""The resumable sink: crashes, gaps, other headers and other sources."""

import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import batches


def test_a_crash_is_resumed(spark):
    folder = tempfile.mkdtemp(prefix="tidemark-batches-")
    source = spark.createDataFrame([(i * 3 - 50, f"t{i}") for i in range(100)] + [(1, "twin"), (1, "twin")], "id long, text string").repartition(5)
    seen = []

    def make(fail):
        def of(rows):
            seen.append(sorted(r.id for r in rows.collect()))
            if fail == len(seen):
                return rows.withColumn("n", F.raise_error(F.lit("crash")).cast("int"))
            return rows.withColumn("n", F.length("text"))

        return of

    with pytest.raises(Exception, match="crash"):
        batches.run(source, "id", make(3), folder, {"model": "a"}, 10)
    assert batches.complete(spark, folder) == [0, 1]
    again = len(seen)
    got = batches.run(source, "id", make(None), folder, {"model": "a"}, 10, most=4)
    assert batches.complete(spark, folder) == list(range(6)) and len(seen) == again + 4
    got = batches.run(source, "id", make(None), folder, {"model": "a"}, 10)
    keys = sorted(r.id for r in source.collect())
    assert seen[again:] == [keys[i : i + 10] for i in range(20, 102, 10)]  # no complete batch is made again
    assert sorted((r.id, r.batch, r.n) for r in got.collect()) == sorted((k, i // 10, n) for i, (k, n) in enumerate(sorted((r.id, len(r.text)) for r in source.collect())))
    with pytest.raises(ValueError, match="header"):
        batches.run(source, "id", make(None), folder, {"model": "b"}, 10)
    with pytest.raises(ValueError, match="place"):
        batches.run(source.where("id <> -50"), "id", make(None), folder, {"model": "a"}, 10)
    shutil.rmtree(os.path.join(folder, "number=4"))
    with pytest.raises(ValueError, match="follow"):
        batches.run(source, "id", make(None), folder, {"model": "a"}, 10)


def test_no_rows_and_no_keys(spark):
    folder = tempfile.mkdtemp(prefix="tidemark-batches-")
    source = spark.createDataFrame([], "id long, text string")
    got = batches.run(source, "id", lambda rows: rows.withColumn("n", F.length("text")), folder, {}, 10)
    assert got.count() == 0 and set(got.columns) == {"id", "text", "n", "batch"}
    with pytest.raises(ValueError, match="place"):
        batches.run(spark.createDataFrame([(None, "x")], "id long, text string"), "id", lambda rows: rows, folder, {}, 10)
