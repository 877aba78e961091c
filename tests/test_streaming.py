"""Streams give what their batch twins give on the same files."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.streaming import rolling

SRC = f"{DATA}/sf0.001/events.parquet"


def as_stream(spark, make, name):
    schema = spark.read.parquet(SRC).schema
    folder = tempfile.mkdtemp(prefix="tidemark-stream-")
    spark.read.parquet(SRC).write.parquet(folder + "/in")
    events = spark.readStream.schema(schema).parquet(folder + "/in").withColumn("ts", F.col("ts").cast("timestamp"))
    q = make(events).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", folder + "/state").start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


@pytest.mark.parametrize("name", ["rolling_scores", "event_buckets", "trigger_sessions"])
def test_stream_equals_batch(spark, name):
    make = {
        "rolling_scores": lambda e: rolling.rolling_scores(e, "ts", "value").withColumn("mean", F.round("mean", 6)),
        "event_buckets": lambda e: rolling.event_buckets(e, "ts", "event_type"),
        "trigger_sessions": lambda e: rolling.trigger_sessions(e.where("value > 60"), "ts", "event_type", "2 hours"),
    }[name]
    batch = spark.read.parquet(SRC).withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted(map(tuple, make(batch).collect()))
    got = as_stream(spark, make, name)
    assert got and set(got) <= set(want)
    assert len(want) - len(got) <= 40  # windows that the watermark has not closed yet


def test_first_seen(spark):
    got = as_stream(spark, lambda e: rolling.first_seen(e, "ts", ["user_id"], "60 days").select("user_id"), "first_seen")
    assert len(got) == spark.read.parquet(SRC).select("user_id").distinct().count()


def test_first_captures_survive_a_stop_between_batches(spark):
    """Files out of order, a query that is stopped while it runs and resumed from its checkpoint, against the earliest rows in one batch."""
    import time

    from tidemark.streaming import stateful

    e = spark.read.parquet(SRC).withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.unionByName(e.limit(200)).withColumns({"row": F.lit(1), "at": F.lit(2), "key": F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 40), "id": F.lit(3)})  # repeats, null keys, clashing names
    folder = tempfile.mkdtemp(prefix="tidemark-stream-")
    rolling.dealt(e, F.unix_micros("ts") + F.col("event_id") * 7919 % 3000 * 1_000_000, 8, 2, folder + "/in")
    make = lambda: stateful.first_captures(rolling.arriving(spark, e.schema, folder + "/in", 2), ["key"], "ts", "event_id")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    try:
        q = make().writeStream.format("parquet").outputMode("append").option("path", folder + "/out").option("checkpointLocation", folder + "/state").start()
        until = time.time() + 120
        while time.time() < until and not (q.lastProgress and q.lastProgress["batchId"] >= 2):
            time.sleep(0.2)
        q.stop()
        got = rolling.written(make(), folder)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got.columns == e.columns
    last = e.agg(F.max(F.unix_micros("ts"))).first()[0] // 1000 - 3_600_000
    want = {}
    for r in e.collect():
        if r.key not in want or (r.ts, str(r.event_id)) < (want[r.key].ts, str(want[r.key].event_id)):
            want[r.key] = r
    want = {k: r for k, r in want.items() if int(r.ts.timestamp() * 1000) + 1 <= last}
    found = {r.key: r for r in got.collect()}
    assert len(found) == got.count() > 0
    assert {k: tuple(r) for k, r in found.items()} == {k: tuple(r) for k, r in want.items()}


def states_of(spark, make, rows, files=2):
    """Rows that `make` gives of `rows` in four micro-batches, and the most entries that its stores of states held."""
    from tidemark.streaming import stateful

    folder = tempfile.mkdtemp(prefix="tidemark-stream-")
    rolling.dealt(rows, F.col("at"), 4, files, folder + "/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    try:
        stream = make(rolling.arriving(spark, rows.schema, folder + "/in", files))
        q = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("path", folder + "/out").option("checkpointLocation", folder + "/state").start()
        q.awaitTermination()
        most = max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
        return [tuple(r) for r in spark.read.schema(stream.schema).parquet(folder + "/out").collect()], most
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def many_keys(spark, n=3000, each=4):
    """`n` keys, a null one among them, null values and a null id beside ids that no double holds."""
    big = (1 << 53) + 1
    rows = [(None if k == 0 else big + k, None if (k, i) == (7, 1) else big + i * n + k, 1_700_000_000_000_000 + i * 1_000_000_000 + k, None if (k + i) % 17 == 0 else float((k * 31 + i * 57) % 97)) for k in range(n) for i in range(each)]
    return spark.createDataFrame(rows, "key long, id long, at long, value double")


def test_running_losses_of_many_keys(spark):
    from tidemark.streaming import stateful

    rows = many_keys(spark).withColumns({"value": F.col("value") - 50, "ts": F.timestamp_micros("at"), "day": F.expr("at div 86400000000")})
    got, states = states_of(spark, lambda e: stateful.running_losses(e, "ts", 25.0), rows)
    total, told, want = {}, set(), []
    for r in sorted(rows.collect(), key=lambda r: r.at):
        total[r.key] = total.get(r.key, 0.0) + (r.value or 0.0)
        if r.key not in told and total[r.key] < -25:
            told.add(r.key)
            want.append((r.key, r.day, r.id, total[r.key]))
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 1000
    assert states <= 2 * stateful.BUCKETS + 8  # a state and a timer for each bucket and day, not for each key


def by_key(rows):
    found = {}
    for r in sorted(rows.collect(), key=lambda r: r.at):
        found.setdefault(r.key, []).append(r)
    return found


def test_fusion_of_many_keys(spark):
    from tidemark.streaming import stateful

    rows = many_keys(spark).withColumns({"a": F.lit(40.0), "b": F.col("id") % 60 * 1.0})
    got, states = states_of(spark, lambda e: stateful.fusion(e, 2, 1_500_000_000), rows)
    want = []
    for key, mine in by_key(rows).items():
        for r in mine:
            known = [((q.value - q.a) ** 2, (q.value - q.b) ** 2) for q in mine if q.at + 1_500_000_000 <= r.at and q.value is not None and q.b is not None][-2:]
            x, y = (1 / max(sum(k[i] for k in known) / len(known), 1e-12) for i in (0, 1)) if known else (None, None)
            weight = x / (x + y) if known else None
            want.append((key, r.id, weight, weight * r.a + (1 - weight) * r.b if known and r.b is not None else None))
    clean = lambda rows: sorted((tuple(None if v != v else v for v in r) for r in rows), key=str)
    assert clean(got) == clean(want) and any(r[2] for r in want)
    assert states <= stateful.BUCKETS


def test_positions_of_many_keys(spark):
    from tidemark.streaming import stateful

    rows = many_keys(spark)
    got, states = states_of(spark, lambda e: stateful.positions(e, 25.0, 0.5, 0.6), rows)
    want = []
    for key, mine in by_key(rows).items():
        entry = peak = None
        for r in mine:
            stop = None if entry is None else max(0.5 * entry, 0.6 * peak)
            if entry is not None and r.value is not None:
                entry, peak = (None, None) if r.value <= stop else (entry, max(peak, r.value))
            elif entry is None and r.value is not None and r.value > 25:
                entry = peak = r.value
            want.append((key, r.id, int(entry is not None), stop))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert states <= stateful.BUCKETS


def test_first_captures_of_many_keys(spark):
    from tidemark.streaming import stateful

    spread = 1_700_000_000_000_000 + (F.col("at") - 1_700_000_000_000_000) * 100  # rows of a key 28 hours apart
    rows = many_keys(spark).withColumn("ts", F.timestamp_micros(spread))
    got, states = states_of(spark, lambda e: stateful.first_captures(e, ["key"], "ts", "id"), rows.withColumn("at", spread))
    assert sorted(r[0] or 0 for r in got) == sorted(r.key or 0 for r in rows.select("key").distinct().collect())
    assert sorted((tuple(r[:2]) for r in got), key=str) == sorted(((mine[0].key, mine[0].id) for mine in by_key(rows).values()), key=str)
    assert states <= 4 * stateful.BUCKETS + 8  # an entry and its timer, which Spark keeps by key and by time


def test_a_processor_gets_packed_rows(spark):
    """What Spark hands to a processor as one tuple each is some packs of a bucket, with the same values."""
    import numpy as np

    from tidemark.streaming import stateful

    rows = many_keys(spark, 20, 400)
    packs = stateful._packed(stateful._dealt(rows, "value"), "value").collect()
    assert len(packs) < rows.count() / 4
    got = [tuple(r) for p in packs for r in zip(*(np.frombuffer(p[c], stateful.KINDS.get(c, "f8")).tolist() for c in (*stateful.KINDS, "value")))]
    want = [tuple(r)[1:-1] + (float("nan") if r.value is None else r.value,) for r in stateful._dealt(rows, "value").collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in want)


def test_fusion_of_values_whose_squares_no_double_holds(spark):
    from tidemark.streaming import stateful

    rows = spark.createDataFrame([(1, i, i * 10, 1e200 if i == 0 else 5.0, 4.0, 3.0) for i in range(8)], "key long, id long, at long, value double, a double, b double")
    got, _ = states_of(spark, lambda e: stateful.fusion(e, 2, 10), rows)
    found = {r[1]: r[2] for r in got}
    assert len(got) == 8 and abs(found[7] - 0.8) < 1e-12  # errors of 1 and 4; the first row has left the window


def test_a_larger_table_comes_in_more_files(spark, monkeypatch):
    """A batch's files follow the table, so that none of the tasks that write and read them grows with it."""
    import glob

    from tidemark.plans import streams
    from tidemark.streaming import stateful

    folders = []
    monkeypatch.setattr(streams, "shared_folder", lambda spark, name: folders.append(tempfile.mkdtemp(prefix=f"tidemark-{name}-")) or folders[-1])
    monkeypatch.setattr(streams, "ROWS", 25)
    n = spark.read.parquet(SRC).count()
    got = streams.resumed(spark, f"{DATA}/sf0.001", lambda e: stateful.positions(streams.keyed(e, "value"), 25.0, 0.5, 0.6), "files")
    assert got.count() == n
    assert len(glob.glob(folders[0] + "/*.parquet")) == 8 * -(-n // 200)


def test_state_has_no_more_parts_than_cores_or_files(spark, monkeypatch):
    """A wide shuffle of the session is none of the store's: each of its parts costs a worker and a commit in every micro-batch."""
    import glob

    from tidemark.plans import streams
    from tidemark.streaming import stateful

    folders = []
    monkeypatch.setattr(streams, "shared_folder", lambda spark, name: folders.append(tempfile.mkdtemp(prefix=f"tidemark-{name}-")) or folders[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    n = spark.read.parquet(SRC).count()
    positions = lambda e: stateful.positions(streams.keyed(e, "value"), 25.0, 0.5, 0.6)
    captures = lambda e: stateful.first_captures(e, ["user_id"], "ts", "event_id")
    try:
        for parts, rows, make, want in ((40, streams.ROWS, captures, 8), (40, -(-n // 96), positions, 12), (3, streams.ROWS, positions, 3)):
            monkeypatch.setattr(streams, "ROWS", rows)
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = streams.resumed(spark, f"{DATA}/sf0.001", make, "parts", 3000 if make is captures else 0)
            assert got.count() == n if make is positions else got.count() > 0
            assert len(glob.glob(folders[-1] + "/state/state/0/[0-9]*")) == want
            assert spark.conf.get("spark.sql.shuffle.partitions") == str(parts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {k: spark.conf.get(k) for k in before} == before
