"""Queries and operators that once did less than the whole job."""

import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF
from tidemark.functions import text
from tidemark.operators import timeline
from tidemark.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_within_makes_no_pairs(spark):
    left = [(i, i * 977 % 5000 - 900) for i in range(120)] + [(200, 50), (200, 4000), (201, None)]
    right = [(i, i * 613 % 4000 - 700) for i in range(60)] + [(90, 20_000), (91, 50), (92, 50), (93, None)]
    for tolerance in (0, 5, 64, 400):
        want = []
        for i, t in left:
            near = [(abs(u - t), j) for j, u in right if t is not None and u is not None and abs(u - t) <= tolerance]
            want += [(i, min(near)[1], min(near)[0])] if near else []
        got = timeline.nearest_within(spark.createDataFrame(left, "l long, t long"), spark.createDataFrame(right, "r long, u long"), "l", "t", "r", "u", tolerance)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nearest_capture_takes_all_events(spark):
    got = QUERIES["jn19_nearest_capture"](spark, SF).agg(F.count(F.lit(1)), F.count_if(F.col("event_id") % 50 != 0)).first()
    assert got[0] == spark.read.parquet(f"{SF}/documents.parquet").count() and got[1] > 0


def test_following_sum(spark):
    left = [("a", i * 977 % 500 - 90) for i in range(60)] + [("b", 3), ("b", 3), ("c", 1), ("a", None)]
    right = [("a", i * 613 % 400 - 70, float(i)) for i in range(90)] + [("a", 20, 5.0), ("a", 20, 7.0), ("b", 4, 1.0), ("b", 3, 9.0), ("a", None, 1.0)]
    for length in (2, 7, 150):
        want = []
        for k, t in {x for x in left if x[1] is not None}:
            inside = [x for j, u, x in right if j == k and u is not None and t < u < t + length]
            want += [(k, t, sum(inside), len(inside))] if inside else []
        got = timeline.following_sum(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, t long, x double"), "k", "t", "x", length, "s")
        assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("part, whole, key, n", [("jn08_events_in_spans", "jn08_events_in_all_spans", "span", 5), ("jn02_forward_return", "jn02_forward_return_of_all", "event_id", 11), ("pf11_half_for_a_bar", "pf11_half_of_all", "o_orderkey", 3)])
def test_no_rows_are_left_out_by_id(spark, part, whole, key, n):
    rows = {r[key]: r for r in QUERIES[whole](spark, SF).collect()}
    assert {i % n for i in rows} == set(range(n))
    assert rows == {r[key]: r for r in QUERIES[part](spark, SF).collect()}


def test_evidence_with_ellipsis_and_punctuation(spark):
    cases = [
        ("Rates rise, as “expected” — again", "\"expected\" - again", 16, "“expected” — again"),
        ("Bank of X cuts its main rate by half", "Bank of X ... main rate", 1, "Bank of X cuts its main rate"),
        ("Bank of X cuts its main rate by half", "of X…main…half", 6, "of X cuts its main rate by half"),
        ("Bank of X cuts, at last: main rate", "cuts at last main", 11, "cuts, at last: main"),
        ("Bank of X cuts", "of X", 6, "of X"),
        ("Bank of X cuts", "X ... Bank", 0, None), ("Bank of X cuts", "", 0, None), ("Bank of X cuts", "!?", 0, None), (None, "x", 0, None), ("x", None, 0, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, h string, e string, pos long, span string")
    got = df.select("i", text.evidence_span(F.col("h"), F.col("e")).alias("x")).select("i", "x.pos", "x.span").orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[2:] for c in cases]


def test_whole_texts_decide(spark, tmp_path):
    rows = [(0, "same line\none", "a"), (1, "same line\ntwo", "b"), (1000, "Same  line one", "c"), (43200 + 37, "x", "d")]
    rows = [(i, t, "en", s, len(t)) for i, t, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in QUERIES["wn23_first_seen_text"](spark, str(tmp_path)).collect()} == {0, 1, 43237}
    days = QUERIES["wn22_novelty_of_texts"](spark, str(tmp_path)).orderBy("day").collect()
    assert sum(r.tokens for r in days) == 4 + 3 and [r.recurring for r in days] == [0, 1] and days[1].recurrence == 1.0
