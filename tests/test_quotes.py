"""Quotes in whole texts against the full table of edit distances."""

import random

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import quotes
from tidemark.plans import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(text, quote, edits):
    if not text or not quote or len(quote) <= edits:
        return None
    spans = [(distance(quote, text[s:e]), s, e) for s in range(len(text)) for e in range(s + 1, len(text) + 1) if abs(e - s - len(quote)) <= edits]
    d, s, e = min(spans, default=(edits + 1, 0, 0))
    return (s, e, d) if d <= edits else None


def test_spans_equal_the_whole_table():
    dice = random.Random(7)
    for _ in range(500):
        text = "".join(dice.choices("abé ", k=dice.randrange(30)))
        lo = dice.randrange(len(text) + 1)
        quote = list(text[lo : lo + dice.randrange(1, 12)])
        for _ in range(dice.randrange(4)):
            at = dice.randrange(len(quote) + 1)
            quote[at : at + dice.randrange(2)] = dice.choices("abxé", k=dice.randrange(2))
        edits = dice.randrange(4)
        assert quotes.span_of(text, "".join(quote), edits) == plain(text, "".join(quote), edits), (text, "".join(quote), edits)


def test_damaged_passages_are_found(spark):
    rows = {r.doc_id: r for r in QUERIES["sc08_damaged_passages"](spark, f"{DATA}/sf0.001").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    assert set(rows) == set(docs)
    for i, text in docs.items():
        lo = i * 7919 % max(1, len(text) - 60)
        piece = text[lo : lo + 60]
        quote = piece[:19] + "⁂" + piece[20:39] + piece[40:]
        r = rows[i]
        if len(piece) == 60:
            found = text[r.start : r.end]
            assert distance(quote, found) == r.edits <= 2 and r.start <= lo + 2
    assert QUERIES["sc08_damaged_passages"](spark, f"{DATA}/sf0.001").where("start is null").count() == sum(quotes.span_of(t, t[(lo := i * 7919 % max(1, len(t) - 60)) : lo + 19] + "⁂" + t[lo + 20 : lo + 39] + t[lo + 40 : lo + 60], 2) is None for i, t in docs.items())


def test_odd_texts(spark):
    long = "many words of a long text " * 40_000 + "the needle stands here" + " and more" * 1000
    df = spark.createDataFrame([(0, None, "a"), (1, "a", None), (2, "", "abc"), (3, "abc", ""), (4, long, "the neadle stnds here"), (5, "abc", "ab"), (6, "abc", "xyzw")], "id long, t string, q string")
    got = {r.id: r.s for r in df.select("id", quotes.quote_span(F.col("t"), F.col("q"), 2).alias("s")).collect()}
    at = long.index("the needle")
    assert tuple(got[4]) == (at, at + 22, 2)
    assert [got[i] for i in (0, 1, 2, 3, 5, 6)] == [None] * 6
