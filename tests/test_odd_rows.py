"""Operators on small literals: nulls, ties, repeats, empty tables, clashing names, rules at their edges, and no look at later rows."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import books, corpus, indicators, ledgers, models, selection, stats, timeline, trials, walkforward
from tidemark.plans import QUERIES
from tidemark.sources import readers
from tidemark.streaming import rolling, stateful

LEFT = [("a", 5, 1), ("a", 5, 1), ("a", 90_000, 2), ("a", 400_000, 3), ("a", -7, 4), ("b", 3, 5), ("c", 9, 6), (None, 4, 7), ("a", None, 8)]
RIGHT = [("a", 5, 1.0), ("a", 5, 2.0), ("a", 86_399, 3.0), ("a", 200_000, None), ("b", 4, 5.0), (None, 1, 6.0), ("a", None, 7.0), ("a", -100_000, 8.0)]


def frames(spark, left=LEFT, right=RIGHT):
    # Columns that operators might use themselves.
    a = spark.createDataFrame(left, "k string, t long, id int").select("*", *(F.lit(i).alias(c) for i, c in enumerate(["b", "x", "n", "v", "asof_k", "sum_x", "gap_t", "rank_x"])))
    return a, spark.createDataFrame(right, "k string, t long, value double")


@pytest.mark.parametrize("bucket", [10, 86_400, 10_000_000])
def test_asof_join(spark, bucket):
    left, right = frames(spark)
    got = timeline.asof_join(left, right, "k", "t", ["value"], bucket)
    assert got.columns == [*left.columns, "value"]
    want = []
    for k, t, i in LEFT:
        known = [(u, (x is not None, x or 0), x) for j, u, x in RIGHT if j == k and None not in (k, t, u) and u <= t]
        want.append((i, max(known)[2] if known else None))
    key = lambda r: (r[0], r[1] is not None, r[1] or 0)
    assert sorted(((r.id, r["value"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert timeline.asof_join(left.limit(0), right, "k", "t", ["value"]).count() == 0
    assert {r["value"] for r in timeline.asof_join(left, right.limit(0), "k", "t", ["value"]).collect()} == {None}


def test_asof_join_sees_nothing_later(spark):
    dice = random.Random(1)
    left = [("a", dice.randrange(1000), i) for i in range(50)]
    right = [("a", dice.randrange(1000), float(i)) for i in range(80)]
    for cut in (100, 500):
        changed = [(k, t, v + 1000 if t > cut else v) for k, t, v in right]
        one, two = ({r.id: r["value"] for r in timeline.asof_join(*frames(spark, left, x), "k", "t", ["value"], 64).collect()} for x in (right, changed))
        assert all(one[i] == two[i] for _, t, i in left if t <= cut)


@pytest.mark.parametrize("closed", ["left", "right"])
def test_interval_sum(spark, closed):
    left, right = frames(spark)
    for length in (1, 3, 86_400, 300_000):
        got = timeline.interval_sum(left, right, "k", "t", "value", length, closed, "s")
        want = []
        for k, t, i in LEFT:
            inside = [x for j, u, x in RIGHT if j == k and None not in (k, t, u) and x is not None and (t - length < u <= t if closed == "right" else t - length <= u < t)]
            want.append((i, sum(inside) if inside else None, len(inside)))
        assert sorted((r.id, r.s, r.s_n) for r in got.collect()) == sorted(want) if all(w[1] is not None for w in want) else sorted(map(repr, ((r.id, r.s, r.s_n) for r in got.collect()))) == sorted(map(repr, want))


def test_gap_clusters(spark):
    times = [0, 10, 10, 25, 86_000, 86_500, 200_000]
    rows = spark.createDataFrame([("a", t) for t in times] + [("b", 7), (None, 3), ("a", None)], "k string, t long")
    got = {(r.k, r.t): r.cluster for r in timeline.cluster_by_gap(rows, "k", "t", 600, 86_400).collect()}
    assert [got["a", t] for t in times] == [1, 1, 1, 1, 2, 2, 3] and got["b", 7] == 1 and got[None, 3] is None and got["a", None] is None
    assert timeline.cluster_by_gap(rows, "k", "t", 600).count() == rows.count()


def test_running_before_and_streaks(spark):
    dice = random.Random(3)
    rows = [(dice.choice("ab"), i // 7, i, dice.random() - 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, day long, id long, x double")
    got = {r.id: r.s for r in timeline.running_before(df, "k", "day", ["id"], {"s": F.col("x")}).collect()}
    for k, _, i, _ in rows:
        assert abs(got[i] - sum(x for j, _, h, x in rows if j == k and h < i)) < 1e-9
    found = {r.k: (r.win, r.loss) for r in indicators.streaks(df, "k", "day", ["id"], F.col("x") > 0).collect()}
    for k in "ab":
        signs = "".join("w" if x > 0 else "l" for j, _, _, x in rows if j == k)
        assert found[k] == (max(map(len, signs.split("l"))), max(map(len, signs.split("w"))))


def test_ranked(spark):
    dice = random.Random(5)
    rows = [(dice.choice(["a", "b", None]), dice.choice([None, 1.0, 2.0, dice.random() * 10]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, id long")
    for parts, slices in ((2, 1), (50, 7)):
        got = {r.id: (r.i, r.i_n) for r in stats.ranked(df, ["k"], F.col("x"), ["id"], "i", parts, slices).collect()}
        for k in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            assert [got[r[2]] for r in own] == [(n + 1, len(own)) for n in range(len(own))]
    assert stats.ranked(df.limit(0), ["k"], F.col("x"), ["id"], "i").count() == 0


def test_selection_limits_are_exact(spark):
    dice = random.Random(2)
    rows = [(dice.choice("xy"), dice.choice("abc"), dice.randrange(50), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, s string, o long, id long")
    for cap in (1, 4, 30):
        nth = {}
        for g, s, o, i in sorted(rows, key=lambda r: (r[2], r[3])):
            nth[i] = sum(1 for h, u, p, j in rows if (h, u) == (g, s) and (p, j) < (o, i)) + 1
        for g in "xy":
            own = [r for r in rows if r[0] == g]
            want = [r[3] for r in sorted(own, key=lambda r: (nth[r[3]], r[1]))][:cap]
            got = [r.id for r in corpus.round_robin(df, "g", "s", ["o", "id"], cap).where(F.col("g") == g).orderBy("place").collect()]
            assert got == want
            want = [r[3] for r in sorted(own, key=lambda r: (nth[r[3]] > 1, r[2], r[3]))][:cap]
            assert [r.id for r in corpus.diverse(df, "g", "s", ["o", "id"], cap).where(F.col("g") == g).orderBy("place").collect()] == want
    even = selection.even_sample(df, ["g"], ["id"], 5).groupBy("g").count().collect()
    assert {r["count"] for r in even} == {5}


def test_trailing_exit_rules(spark):
    bars = spark.createDataFrame([("s", 1, 100.0, 104.0, 99.0), ("s", 2, 103.0, 120.0, 96.0), ("s", 3, 90.0, 91.0, 80.0)], "k string, day long, open double, high double, low double")
    def stopped(own, atr):
        t = spark.createDataFrame([(1, "s", 1, 3, 100.0, own, atr)], "id int, k string, entry long, exit long, entry_price double, stop double, atr double")
        return [tuple(r) for r in walkforward.trailing_exits(t, bars, "id", "k", "day", 2.0).collect()]
    assert stopped(95.0, 100.0) == [(1, 3, "gap_stop", 90.0, 95.0)]  # the open is below the stop
    assert stopped(97.0, 100.0) == [(1, 2, "intrabar_stop", 97.0, 97.0)]
    assert stopped(50.0, 5.0) == [(1, 3, "gap_stop", 90.0, 110.0)]  # peak 104 before the second bar, 120 after it
    assert stopped(50.0, None) == [] and stopped(50.0, 100.0) == []


def test_admission_keeps_the_first(spark):
    rows = [(1, "t", "u", None), (2, "t", "w", None), (3, "x", "u", None), (4, "t", "z", "host"), (5, None, "q", None), (6, None, "r", None), (7, "y", "w", None)]
    out = corpus.admitted(spark.createDataFrame(rows, "id long, title string, url string, reason string"), "reason", [("title", "title"), ("url", "url")], ["id"])
    assert {r.id: r.reason for r in out.collect()} == {1: None, 2: "title", 3: "url", 4: "host", 5: None, 6: "title", 7: None}


def test_reconciliation_names_what_differs(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, 1.0, None), (4, None, None)], "id int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.5, 2.0), (3, 1.0, 1.0), (4, None, None), (5, 0.0, 0.0)], "id int, x double, y double")
    out = {r.id: (r.parts, r.error) for r in ledgers.reconcile(a, b, "id", ["x", "y"], 1e-6).collect()}
    assert out == {2: ("x", 0.5), 3: ("y", float("inf")), 5: ("missing", None)}


def test_tail_classifier_equals_newton(spark):
    dice = np.random.default_rng(3)
    x = np.c_[dice.normal(size=(400, 2)) * [1, 5] + [3, -2], np.ones(400)]
    y = dice.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 3 - 0.2 * x[:, 1] - 2)))
    rows = [(i, float(a), float(b), 7.0, float(t), i < 300) for i, ((a, b, _), t) in enumerate(zip(x, y))] + [(900, None, 1.0, 7.0, 1.0, True)]
    df = spark.createDataFrame(rows, "id int, a double, b double, constant double, tail double, train boolean")
    got = {r.id: r.probability for r in models.tail_classifier(df, ["a", "b", "constant"], "tail", F.col("train")).collect()}
    z = (x[:, :2] - x[:300, :2].mean(0)) / x[:300, :2].std(0)
    z = np.c_[z, np.ones(400)]
    w, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z[:300] @ w))
        w -= np.linalg.solve((z[:300] * (p * (1 - p))[:, None]).T @ z[:300] + ridge, z[:300].T @ (p - y[:300]) + ridge @ w)
    assert got[900] is None and np.allclose([got[i] for i in range(400)], 1 / (1 + np.exp(-z @ w)), atol=1e-5)
    one = models.tail_classifier(df.withColumn("tail", F.lit(0.0)), ["a"], "tail", F.col("train"))
    assert {r.probability for r in one.where("a is not null").collect()} == {0.0}
    labels = models.tail_labels(spark.createDataFrame([("s", float(i), True) for i in range(11)] + [("s", None, True), ("t", 1.0, False)], "k string, y double, train boolean"), "k", "y", F.col("train"))
    assert {r.y: r.tail for r in labels.collect()} == {float(i): float(i <= 1) for i in range(11)}


def test_tail_query_has_every_row(spark):
    out = QUERIES["ml06_tail_classifier"](spark, f"{DATA}/sf0.01")
    n, bad, tails, p = out.agg(F.count(F.lit(1)), F.count_if(F.col("probability").isNull() | ~F.col("probability").between(0, 1)), F.sum("tail"), F.avg("probability")).first()
    assert n > 10_000 and bad == 0 and 0.05 < tails / n < 0.15 and 0.05 < p < 0.15


def test_scorers_are_built_once_a_task(spark):
    built = spark.sparkContext.accumulator(0)

    def make():
        built.add(1)
        return lambda texts: [float(len(t)) for t in texts]

    docs = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(50)], "id long, body string").repartition(2)
    assert {r.id: r.score for r in models.score_batches(docs, make, "id", "body").collect()} == {i: float(0 if i == 3 else i) for i in range(50)}
    assert built.value == 2
    none = models.embed_batches(docs, lambda: lambda texts: [[[0.0, 0.0]] if len(t) % 2 else [] for t in texts], "id", "body")
    assert {r.vector for r in none.collect()} == {None}


def test_exact_headers_and_bad_archives(spark, tmp_path):
    spark.createDataFrame([("1", "x")], "a string, b string").write.csv(f"{tmp_path}/t", header=True, sep="\t")
    assert readers.read_exact(spark, f"{tmp_path}/t", ["a", "b"]).count() == 1
    for wrong in (["b", "a"], ["a", "c"]):
        with pytest.raises(Exception):
            readers.read_exact(spark, f"{tmp_path}/t", wrong).collect()
    import hashlib
    import zipfile

    for name, members in {"good": ["good.csv"], "two": ["two.csv", "more.csv"], "other": ["x.csv"], "short": ["short.csv"], "unlisted": ["unlisted.csv"]}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for m in members:
                z.writestr(m, "1,2\n" if name == "short" else "1,2,3\n4,5,6\n")
    sums = [(n, hashlib.sha256((tmp_path / f"{n}.zip").read_bytes()).hexdigest()) for n in ("good", "two", "other", "short")] + [("gone", "0")]
    good, bad = readers.read_archives(spark, str(tmp_path), spark.createDataFrame(sums, "name string, sha256 string"), 3)
    assert sorted(tuple(r.fields) for r in good.collect()) == [("1", "2", "3"), ("4", "5", "6")]
    assert {r.name: r.reason for r in bad.collect()} == {"two": "members", "other": "members", "short": "columns", "unlisted": "unlisted", "gone": "missing"}


def test_deflation_needs_more_than_one_trial(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.0)], "c string, r double")
    assert trials.deflated_by_trials(df, "c", "r").first()["expected_best"] == 0.0


# Streams in many batches: the state must go from one to the next.


def in_batches(spark, make, rows, schema, name):
    """Runs a stream over one file for each list of rows, in order, one a batch."""
    folder = tempfile.mkdtemp(prefix="tidemark-stream-")
    for i, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    try:
        return rolling.written(make(stream), folder).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_positions_go_on_from_batch_to_batch(spark):
    dice = random.Random(4)
    rows = [(i % 3, i, i * 1000, None if i == 50 else dice.random() * 50) for i in range(150)]
    batches = [rows[at : at + 40] for at in range(0, 150, 40)]
    schema = "key long, id long, at long, value double"
    got = {r.id: (r.held, r.stop) for r in in_batches(spark, lambda s: stateful.positions(s, 25.0, 0.5, 0.6), batches, schema, "p")}
    for k in range(3):
        entry = peak = None
        for _, i, _, v in (r for r in rows if r[0] == k):
            stop = None if entry is None else max(0.5 * entry, 0.6 * peak)
            if v is not None:
                if entry is None:
                    entry = peak = v if v > 25 else None
                elif v <= stop:
                    entry = peak = None
                else:
                    peak = max(peak, v)
            assert got[i][0] == int(entry is not None) and (got[i][1] is None) == (stop is None) and (stop is None or abs(got[i][1] - stop) < 1e-12)


def test_fusion_knows_only_what_has_matured(spark):
    dice = random.Random(6)
    rows = [(i % 2, i, i * 10, dice.random(), dice.random(), dice.random()) for i in range(60)]
    got = {r.id: r.weight for r in in_batches(spark, lambda s: stateful.fusion(s, 4, 55), [rows[at : at + 13] for at in range(0, 60, 13)], "key long, id long, at long, value double, a double, b double", "f")}
    for k, i, at, *_ in rows:
        known = [r for r in rows if r[0] == k and r[2] + 55 <= at][-4:]
        if not known:
            assert got[i] is None
            continue
        x, y = (1 / (sum((r[3] - r[j]) ** 2 for r in known) / len(known)) for j in (4, 5))
        assert abs(got[i] - x / (x + y)) < 1e-9


def test_alert_comes_once_a_day(spark):
    rows = [[(1, d, 10 * d + i, (d * 86_400 + i * 3600) * 1_000_000, -10.0) for i in range(3)] for d in range(20_000, 20_004)] + [[(1, 20_003, 9, (20_003 * 86_400 + 9 * 3600) * 1_000_000, -50.0)]]
    make = lambda s: stateful.running_losses(s.withColumn("ts", F.timestamp_micros("at")), "ts", 15.0)
    got = in_batches(spark, make, rows, "key long, day long, id long, at long, value double", "l")
    assert sorted((r.day, r.id, r.total) for r in got) == [(d, 10 * d + 1, -20.0) for d in range(20_000, 20_004)]


def test_trailing_scores_hold_their_end_and_not_their_start(spark):
    hour = 3_600_000_000
    base = 480_000  # hours: the watermark starts at zero
    rows = [[((base + h) * hour, v) for h, v in some] for some in ([(0, 1.0), (4, 5.0), (24, 3.0)], [(72, 0.0)], [(96, 0.0)])]
    make = lambda s: rolling.trailing_scores(s.withColumn("ts", F.timestamp_micros("at")), "ts", "value")
    got = {int(r.decision.timestamp()) // 3600 - base: (r["mean"], r["median"], r.n) for r in in_batches(spark, make, rows, "at long, value double", "t")}
    assert got[0] == (1.0, 1.0, 1) and got[4] == (3.0, 3.0, 2) and got[24] == (4.0, 4.0, 2) and got[28] == (3.0, 3.0, 1)


def test_sessions_hold_gaps_of_their_length(spark):
    minute = 60_000_000
    rows = [[(0,), (60 * minute,), (121 * minute,)], [(500 * minute,)], [(900 * minute,)]]
    make = lambda s: rolling.trigger_sessions(s.withColumn("ts", F.timestamp_micros("at")).withColumn("k", F.lit("a")), "ts", "k", "60 minutes")
    got = sorted((int(r.start.timestamp()) // 60, int(r.end.timestamp()) // 60, r.n) for r in in_batches(spark, make, rows, "at long", "s"))
    assert got[:2] == [(0, 120, 2), (121, 181, 1)]


def test_names_that_operators_use_may_be_taken(spark):
    from tidemark.operators import corpus, walkforward

    rows = [(k, i, float(i % 7) if i % 9 else None, f"s{i % 3}", "kept") for i in range(60) for k in ("a", "b", None)]
    plain = spark.createDataFrame([r[:4] for r in rows], "g string, t long, x double, s string")
    clash = spark.createDataFrame([(*r[:4], *[r[4]] * 4) for r in rows], "g string, t long, x double, s string, lo string, hi string, nth string, tercile_key string")
    for call in (lambda d: walkforward.tercile_classes(d, "g", "x", F.col("t") < 30, 6), lambda d: corpus.round_robin(d, "g", "s", ["t"], 5)):
        added = [c for c in call(plain).columns if c in ("class", "place")]
        assert sorted(map(repr, call(plain).select("g", "t", "x", *added).collect())) == sorted(map(repr, call(clash).select("g", "t", "x", *added).collect()))
        assert {tuple(r) for r in call(clash).select("lo", "hi", "nth", "tercile_key").collect()} == {("kept",) * 4}
        assert call(clash.limit(0)).count() == 0
