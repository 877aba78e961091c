"""The page parser against pages built from known paragraphs."""

import html
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import pages
from tidemark.plans import QUERIES


@pytest.mark.parametrize(
    "source, want",
    [
        ("<nav>a<script>b</script>c<ul><li>d</ul></nav>e", ["e"]),
        ("<div><nav>never closed<p>x</div>after", ["after"]),
        ("<p>one<p>two<br>lines</p>three", ["one", "two lines", "three"]),
        ("it&#8217;s &eacute;t&#xE9; &amp;lt; &nbsp; end", ["it’s été &lt; end"]),
        ("<script>if (a</p>b) {}</script>x<!-- <p>no --><style>p{}</style>", ["x"]),
        ("a</div></nav></p>b<b>c</b>", ["a", "b" + "c"]),
        ("<ul><li>one<li>two<ul><li>three</ul></ul>", ["one", "two", "three"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("x < y and 3 > 2 & z", ["x < y and 3 > 2 & z"]),
        ("<p>text<script>never closed <p>gone", ["text"]),
        ("<svg><title>no</title></svg><noscript><p>no</p></noscript>yes", ["yes"]),
        ("", []),
        ("   \n\t ", []),
        ("<p></p><div> </div>", []),
        ("<P CLASS='a>b'>upper</P>", ["upper"]),
        ("<div/>a<nav/>b", ["a"]),  # a slash does not close: the rest is navigation, as in a browser
    ],
)
def test_paragraphs(source, want):
    if source == "a</div></nav></p>b<b>c</b>":
        want = ["abc"]  # end tags without a start are ignored
    assert pages.Page(source).paragraphs == want


def test_title_and_links():
    p = pages.Page("<head><title>A &amp; B</title></head><nav><a href='/no'>n</a></nav><a href='/yes'>y</a><a name=x>z</a>")
    assert (p.title, p.links, p.paragraphs) == ("A & B", ["/yes"], ["yz"])


def built(dice, depth=0):
    """A piece of a page and its paragraphs; it begins and ends with a block's edge."""
    kind = dice.randrange(6 if depth < 4 else 3)
    words = [dice.choice(["alpha", "bêta", "<tag>", "&", "naïve", "x y"]) for _ in range(dice.randrange(1, 6))]
    if kind == 0:
        spoken = "".join(dice.choice([html.escape, lambda w: "".join(f"&#{ord(c)};" for c in w), lambda w: f"<b>{html.escape(w)}</b>"])(w) + dice.choice([" ", "\n", "<br>"]) for w in words)
        return f"<p>{spoken}{dice.choice(['</p>', '</p>', '<div></div>'])}", [" ".join(" ".join(words).split())]
    if kind == 1:
        skipped = dice.choice(["script", "style"])
        return f"<{skipped}>var a = '<p>';</{skipped}><div></div>", []
    if kind == 2:
        return f"<!-- <p>{words[0].replace('>', '')} --><div></div>", []
    parts = [built(dice, depth + 1) for _ in range(dice.randrange(4))]
    inner, kept = "".join(p for p, _ in parts), [x for _, k in parts for x in k]
    if kind == 3:
        return f"<nav>{inner}</nav>", []
    tag = dice.choice(["div", "section", "blockquote"])
    return f"<{tag}>{inner}</{tag}>", kept


def test_built_pages(spark):
    dice = random.Random(6)
    made = [built(dice) for _ in range(400)] + [("<div>" * 3000 + "deep" + "</div>" * 3000, ["deep"]), ("<p>" + "long words " * 100_000, [("long words " * 100_000).strip()])]
    df = spark.createDataFrame([*((i, p) for i, (p, _) in enumerate(made)), (-1, None)], "id long, html string")
    got = {r.id: r.page for r in df.select("id", pages.page(F.col("html")).alias("page")).collect()}
    assert got.pop(-1) is None
    for i, (_, want) in enumerate(made):
        assert got[i].paragraphs == want, made[i]
    assert df.limit(0).select(pages.page(F.col("html"))).count() == 0


def test_queries_on_pages(spark):
    sf = f"{DATA}/sf0.001"
    rows = QUERIES["src09_paragraphs"](spark, sf).collect()
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        p = pages.Page(r.html)
        own = sorted((x for x in rows if x.page_id == r.page_id), key=lambda x: x.place if x.place is not None else -1)
        assert [x.text for x in own if x.text is not None] == p.paragraphs and {x.title for x in own} == {p.title} and {x.n_links for x in own} == {len(p.links)}
    keys = QUERIES["sc01_folded"](spark, sf).agg(F.sum("n"), F.count(F.lit(1))).first()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert keys[0] == len(texts) and keys[1] == len({" ".join(html.unescape(t or "").casefold().split()) for t in texts})
    sharp = spark.createDataFrame([("STRAße &amp; É&#769;",), (None,)], "t string").select(pages.folded(F.col("t"))).collect()
    assert [r[0] for r in sharp] == ["strasse & é́", None]


def test_models_get_texts_in_pieces(spark):
    """A model never gets more than a piece of a batch, and every text once, long and null ones too."""
    from pyspark.sql import functions as F

    from tidemark.operators import models

    def make():
        def model(texts):
            if len(texts) > 1 and sum(map(len, texts)) > 1 << 18:
                raise ValueError("too much text at once")
            return [[[float(len(t)), 1.0]] for t in texts]

        return model

    docs = spark.range(60).select("id", F.when(F.col("id") % 7 > 0, F.expr("repeat('x', cast(id * id * 150 as int))")).alias("text"))
    got = {r.id: r.vector for r in models.embed_batches(docs.coalesce(1), make, "id", "text").collect()}
    sizes = {i: i * i * 150 if i % 7 else 0 for i in range(60)}
    assert {i: round(v[0] / v[1]) for i, v in got.items()} == sizes


def test_pages_of_a_batch_are_parsed_in_pieces(monkeypatch):
    """What Python holds of a batch is a piece of it, not all its pages and paragraphs; nulls and one long page keep their places."""
    import tracemalloc

    import pyarrow as pa

    from tidemark.functions import pages

    kept = []
    monkeypatch.setattr(pages.F, "arrow_udf", lambda kind: lambda f: lambda column: kept.append(f))
    pages.page(None)
    texts = [None if i % 50 == 7 else f"<title>t{i}</title>" + f"<p>{'word ' * 40}{i}</p>" * (2000 if i == 3 else 40) for i in range(1000)]
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    try:
        found = kept[0](batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 << 20 < batch.nbytes
    assert [r and (r["title"], len(r["paragraphs"])) for r in found.to_pylist()] == [None if t is None else (f"t{i}", 2000 if i == 3 else 40) for i, t in enumerate(texts)]
