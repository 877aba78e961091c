"""Sliding ranks and term search against plain loops."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import terms
from tidemark.operators import order_statistics


def test_wavelet_counts():
    dice = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 300):
        ranks = dice.integers(0, max(1, n // 3), n)
        low, high = np.sort(dice.integers(0, n + 1, (2, 60)), axis=0)
        asked = dice.integers(0, max(1, n // 2), 60)
        smaller, equal = order_statistics.smaller_in_ranges(ranks, low, high, asked)
        assert smaller.tolist() == [int((ranks[a:b] < q).sum()) for a, b, q in zip(low, high, asked)]
        assert equal.tolist() == [int((ranks[a:b] == q).sum()) for a, b, q in zip(low, high, asked)]


@pytest.mark.parametrize("span, least", [(1, 1), (7, 2), (40, 5)])
def test_percentile_equals_a_loop(spark, span, least):
    dice = random.Random(span)
    rows = [(dice.choice(["a", "b", None]), dice.choice([None, *range(-60, 60)]), dice.choice([None, 1.0, 2.0, 3.5, -1.0, float("nan")]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, time long, value double, id long").select("*", *(F.lit(1).alias(c) for c in ("k", "t", "x", "b", "own", "share", "p")))
    found = order_statistics.trailing_percentile(df, "key", "time", "value", span, least, "out")
    assert found.columns == [*df.columns, "out"]
    got = {r.id: r.out for r in found.collect()}
    assert len(got) == len(rows)
    greater = lambda a, b: (math.isnan(a) and not math.isnan(b)) or a > b
    for k, t, v, i in rows:
        want = None
        if None not in (k, t, v):
            seen = [x for q, u, x, _ in rows if q == k and u is not None and x is not None and t - span <= u < t]
            if len(seen) >= least:
                want = sum(1.0 if greater(x, v) else 0.5 if not greater(v, x) else 0.0 for x in seen) / len(seen)
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-12
    assert order_statistics.trailing_percentile(df.limit(0), "key", "time", "value", span, least, "out").count() == 0


def test_terms_equal_plain_search():
    dice = random.Random(2)
    for case in range(300):
        words = tuple(sorted({"".join(dice.choices("abé ", k=dice.randrange(1, 5))) for _ in range(dice.randrange(8))}))
        text = "".join(dice.choices("abéAB .", k=dice.randrange(40)))
        low = text.translate(terms.LOWER)
        every = sorted(((i, w) for w in words for i in range(len(low)) if low.startswith(w, i)), key=lambda x: (x[0], len(x[1])))
        assert terms.hits_of(text, words, True, False, False) == every
        whole = [(i, w) for i, w in every if (i == 0 or not low[i - 1].isalnum()) and (i + len(w) == len(low) or not low[i + len(w)].isalnum())]
        assert terms.hits_of(text, words, True, True, False) == whole
        end, kept = 0, []
        for i in range(len(low)):
            here = [w for j, w in every if j == i]
            if here and i >= end:
                kept.append((i, here[-1]))
                end = i + len(here[-1])
        assert terms.hits_of(text, words, True, False, True) == kept


def test_many_terms_in_one_pass(spark):
    many = [f"alias{i:05d}" for i in range(50_000)]
    rows = [(i, " ".join(f"Alias{(i * 37 + j * 101) % 60_000:05d}" for j in range(200))) for i in range(300)] + [(-1, None), (-2, ""), (-3, "x" * 1_000_000 + "alias00007")]
    df = spark.createDataFrame(rows, "id long, text string")
    began = time.time()
    got = {r.id: [(h.start, h.term) for h in r.hits] for r in df.select("id", terms.term_hits(F.col("text"), many, whole_words=True).alias("hits")).collect()}
    assert time.time() - began < 60
    known = set(many)
    for i, text in rows:
        if i >= 0:
            assert got[i] == [(j * 11, w.lower()) for j, w in enumerate(text.split()) if w.lower() in known]
    assert got[-1] == got[-2] == got[-3] == []
    assert df.limit(0).select(terms.term_hits(F.col("text"), ["a"])).count() == 0
    with pytest.raises(ValueError):
        terms.term_hits(F.col("text"), map(str, range(terms.MOST + 1)))


def test_ranking_makes_its_rows_once(spark):
    """What makes the rows runs once; places equal those of a sort, with ties, nulls and not-a-number."""
    from tidemark.operators import stats

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    values = [None if i % 41 == 0 else float("nan") if i % 37 == 0 else float(i * 7919 % 601) for i in range(3000)]
    rows = spark.createDataFrame([(i % 3, i, v) for i, v in enumerate(values)], "g int, k long, x double").mapInArrow(counted, "g int, k long, x double")
    got = {r.k: (r.place, r.place_n) for r in stats.ranked(rows, ["g"], F.col("x"), ["k"], "place").collect()}
    order = lambda i: (values[i] is not None, values[i] is not None and values[i] != values[i], values[i] if values[i] is not None and values[i] == values[i] else 0.0, i)
    for g in range(3):
        mine = sorted(range(g, 3000, 3), key=order)
        assert [got[i] for i in mine] == [(p + 1, len(mine)) for p in range(len(mine))]
    assert seen.value == 3000
