"""Toxicity: a counterfactually regularised linear classifier.

Features are the distinct words of a text and the distinct 4-grams of characters in them. The model is a logistic regression over the
`FEATURES` features with the largest chi-square, found by Spark over a bounded labelled sample. Every sampled text gives a counterfactual pair: where it names a group of people,
the text and a copy that names another group of the same kind; where it names none, two copies with a neutral mention put in, of one group and of the next of its kind, which a hash of the text chooses from
those of all languages. The loss adds `SWAP_PENALTY` times the mean squared difference of a pair's scores, so a neutral mention of a group can't carry weight of its own.

The sample: the `SAMPLE_DOCS` labelled training documents with the smallest hash of their id, taken from those whose hash is below a threshold that leaves about `OVER` times
as many. Only their selected features (at most `SAMPLE_DOCS` x `FEATURES` small integers) reach the driver.

Cases: null or empty text has the score of a text without features; rows without a label or an id, and labels without a row, are not learnt from; ids labelled twice count
twice; with no labelled row every score is 0; repeated rows are rows of their own; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, fresh, give_back, named, staged_at, with_arrow_column

SAMPLE_DOCS, OVER, FEATURES, BUCKETS, SWAP_PENALTY, RIDGE, ROUNDS = 24_000, 2, 1_000, 1 << 22, 1.0, 1e-3, 400
THRESHOLD = 0.3
WORD = re.compile(r"[^\W_]+")

# Neutral names of groups of people, by kind and language; a counterfactual puts the next of the same kind.
GROUPS = [
    ["women", "men"],
    ["woman", "man"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrant", "native", "refugee", "foreigner"],
    ["immigrants", "natives", "refugees", "foreigners"],
    ["young", "old"],
    ["disabled", "deaf", "blind"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["einwanderer", "einheimische", "flüchtlinge", "ausländer"],
    ["schwule", "lesben", "heterosexuelle", "bisexuelle"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["immigrés", "autochtones", "réfugiés", "étrangers"],
    ["homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["inmigrantes", "nativos", "refugiados", "extranjeros"],
    ["homosexuales", "lesbianas", "heterosexuales", "bisexuales"],
]
MENTIONS = [(a, b) for kind in GROUPS for a, b in zip(kind, [*kind[1:], kind[0]], strict=True)]
SWAP = dict(reversed(MENTIONS))  # a name of two kinds goes by the first


def counterfactual(text: str | None) -> tuple[set[str], set[str]]:
    """The distinct words of a text's pair."""
    words = set(words_of(text))
    if not SWAP.keys().isdisjoint(words):
        return words, {SWAP.get(w, w) for w in words}
    a, b = MENTIONS[crc32((text or "").encode("utf-8", "surrogatepass")) % len(MENTIONS)]
    return words | {a}, words | {b}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of_word(word: str) -> list[int]:
    edged = f"^{word}$"
    return [crc32(x.encode()) % BUCKETS for x in {"=" + word, *(edged[i : i + 4] for i in range(len(edged) - 3))}]


def _distinct(words: set[str], known: dict[str, list[int]]) -> np.ndarray:
    for w in words:
        if w not in known:
            if len(known) > 50_000:
                known.clear()
            known[w] = features_of_word(w)
    return np.unique(np.concatenate([known.get(w) or features_of_word(w) for w in words])).astype(np.int32) if words else np.zeros(0, np.int32)


def _three(text: str | None, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of a text and of its counterfactual pair."""
    words = set(words_of(text))
    own, (one, other) = _distinct(words, known), counterfactual(text)
    if one == words:
        return own, own, _distinct(other, known)
    return own, *(np.union1d(own, _distinct(x - words, known)) for x in (one, other))


@dataclass
class Model:
    """Weights by feature, and the score of a text; `pairs`: counterfactual pairs that differ, `gap`: the mean difference of their scores after training."""

    bias: float = -np.inf
    weights: dict[int, float] = field(default_factory=dict)
    pairs: int = 0
    gap: float = 0.0

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = tuple(f for f in features_of_word(word) if f in self.weights)
        if len(self.known) < 100_000:
            self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        known = self.known
        present: set[int] = set()
        for w in set(words_of(text)):
            found = known.get(w)
            present.update(self._of(w) if found is None else found)
        return float(1 / (1 + np.exp(-(self.bias + sum(map(self.weights.__getitem__, sorted(present)))))))


def train(features: list[np.ndarray], swapped: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int, penalty: float = SWAP_PENALTY, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam steps over the whole sample. Column numbers are 0 to n - 1; `swapped` holds the columns of each counterfactual pair."""
    rows = np.repeat(np.arange(len(features)), [len(x) for x in features])
    cols = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    change = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in swapped if not np.array_equal(a, b)]  # what both have cancels
    d_rows = np.concatenate([*(np.full(len(a) + len(b), k) for k, (a, b) in enumerate(change)), np.zeros(0, np.int64)]).astype(np.int64)
    d_cols = np.concatenate([*(np.concatenate((a, b)) for a, b in change), np.zeros(0, np.int64)]).astype(np.int64)
    d_sign = np.concatenate([*(np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in change), np.zeros(0)])
    w, bias = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(rows, w[cols], len(features)))))
        err = (p - labels) / len(features)
        grad = np.r_[np.bincount(cols, err[rows], n) + ridge * w / max(1, n), err.sum()]
        if change:
            delta = np.bincount(d_rows, d_sign * w[d_cols], len(change))
            grad[:n] += penalty * 2 / len(change) * np.bincount(d_cols, d_sign * delta[d_rows], n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:n], bias - move[n]
    return float(bias), w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, features: int = FEATURES, penalty: float = SWAP_PENALTY) -> Model:
    """`labels`: id_col and label_col (0 or 1) of the rows that may be learnt from."""
    usable = labels.where(named(label_col).isin(0, 1) & named(id_col).isNotNull()).select(named(id_col).alias("l_id"), named(label_col).cast("int").alias("label"))
    low = int(min(1.0, OVER * sample_docs / max(1, usable.count())) * (1 << 30))
    hashed = usable.withColumn("hash", F.pmod(F.xxhash64("l_id"), F.lit(1 << 30))).where(F.col("hash") < low)
    sample = hashed.orderBy("hash", "l_id", "label").limit(sample_docs).select("l_id", "label")
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("l_id"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        kind = pa.list_(pa.int32())
        for batch in batches:
            made: tuple[list, list, list] = [], [], []
            for t in batch.column("text"):  # one text at a time: only the features of a batch are held
                own, one, other = _three(t.as_py(), known)
                for held, x in zip(made, (own, one, other), strict=True):
                    held.append(x)
            yield pa.record_batch([batch.column("label"), *(pa.array(x, kind) for x in made)], names=["label", "own", "one", "other"])
            give_back()

    taken, taken_at = staged_at(rows.select("text", "label").mapInArrow(lists, "label int, own array<int>, one array<int>, other array<int>"), "toxicity-sample")
    totals = taken.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    n, n1 = totals["n"], totals["n1"]
    if not n:
        discard(docs.sparkSession, taken_at)
        return Model()
    counts = taken.select("label", F.explode("own").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("a"), F.sum("label").alias("a1"))
    a, a1 = F.col("a").cast("double"), F.col("a1").cast("double")
    chi = n * F.pow(a1 * n - a * n1, 2) / (a * (n - a + 1e-9) * (n1 + 1e-9) * (n - n1 + 1e-9))
    chosen = [r["f"] for r in counts.select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").limit(features).collect()]
    groups = sorted({f for w in SWAP for f in features_of_word(w)})
    columns = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *groups]))}
    known = docs.sparkSession.sparkContext.broadcast(np.array(sorted(columns), np.int32))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            pick = lambda name: pa.array([np.intersect1d(x.values.to_numpy(), known.value) for x in batch.column(name)], kind)  # noqa: E731, B023
            yield pa.record_batch([batch.column("label"), pick("own"), pick("one"), pick("other")], names=["label", "own", "one", "other"])

    got = taken.mapInArrow(narrowed, "label int, own array<int>, one array<int>, other array<int>").toArrow()
    discard(docs.sparkSession, taken_at)
    as_columns = lambda name: [np.array([columns[f] for f in x], np.int64) for x in got.column(name).to_pylist()]
    own, pairs = as_columns("own"), list(zip(as_columns("one"), as_columns("other"), strict=True))
    bias, w = train(own, pairs, got.column("label").to_numpy(), len(columns), penalty)
    gaps = [abs(_sigmoid(bias + w[a].sum()) - _sigmoid(bias + w[b].sum())) for a, b in pairs if not np.array_equal(a, b)]
    return Model(bias, {f: float(w[i]) for f, i in columns.items()}, len(gaps), float(np.mean(gaps)) if gaps else 0.0)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-x)))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str | None = None) -> DataFrame:
    """`docs` with a column (double, 0 to 1) of every whole text's score. Its name is `out`, or else `fresh(docs, "toxicity")`."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def make() -> Callable[[pa.Array], pa.Array]:
        mine = Model(*sent.value)

        def of(texts: pa.Array) -> pa.Array:
            scores = pa.array([mine.score(t.as_py()) for t in texts], pa.float64())
            give_back()
            return scores

        return of

    return with_arrow_column(docs, text_col, make, out or fresh(docs, "toxicity"), T.DoubleType())
