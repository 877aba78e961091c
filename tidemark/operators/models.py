"""Pluggable models over batches of texts, and a classifier of the worst outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import pieces
from tidemark.operators.percentiles import exact_percentiles


def score_batches(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[float]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (double) of every text by a pluggable scorer. `make` builds it once a task (loads weights, opens what it needs); it then gets lists of texts, one Arrow batch each.

    Cases: a null text reaches the scorer as empty; repeated rows are scored each; an empty table gives an empty result; no other column is read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), pa.array(scorer(b.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(of, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def embed_batches(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[list[list[float]]]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, vector (array<double>): the mean of a text's part vectors, of length one. `make` builds the model once a task; it gives for each text a list of vectors, one for each part.
    The model gets the texts of a batch in pieces of about 256 KB, as part vectors of a whole batch may be a hundred times its texts.

    Cases: a text without parts, or whose mean is zero, has a null vector; null texts reach the model as empty.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = make()
        for b in batches:
            for piece in pieces(b, 1):
                out = []
                for parts in model(piece.column(1).to_pylist()):
                    mean = np.asarray(parts, float).mean(0) if len(parts) else np.zeros(1)
                    norm = float(np.sqrt(mean @ mean))
                    out.append((mean / norm).tolist() if norm > 0 else None)
                yield pa.record_batch([piece.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "vector"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(of, f"id {docs.schema[id_col].dataType.simpleString()}, vector array<double>").withColumnRenamed("id", id_col)


def tail_labels(rows: DataFrame, key: str, y: str, train: Column, share: float = 0.1) -> DataFrame:
    """`tail` 1 where y is at or below the key's lowest share of its training rows, else 0; null y, and keys without training rows, have none and are left out."""
    cuts = exact_percentiles(rows.where(train), [key], y, {"cut": share}).select(F.col(f"`{key}`").alias("tail_key"), F.col("cut").alias("tail_cut"))
    joined = rows.where(F.col(y).isNotNull()).join(cuts, F.col(key).eqNullSafe(F.col("tail_key")))
    return joined.withColumn("tail", (F.col(y) <= F.col("tail_cut")).cast("double")).drop("tail_key", "tail_cut")


def tail_classifier(rows: DataFrame, features: list[str], label: str, train: Column, c: float = 1.0) -> DataFrame:
    """`rows` with `probability`: L2 logistic regression (penalty 1 / c over the sum of losses) fitted on the training rows, features standardised by them (population deviation; constant ones count nothing).

    Rows with a null feature have a null probability and are not learnt from; with one class only, the probability is its share.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT  # noqa: F401
    from pyspark.ml.feature import VectorAssembler

    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull()
    known = rows.where(complete & train & F.col(label).isNotNull())
    m = known.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("p"), *(F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features))).first()
    if not m["n"] or m["p"] in (0.0, 1.0):
        return rows.withColumn("probability", F.when(complete, F.lit(m["p"]).cast("double")))
    names = [f"tail_f{i}" for i in range(len(features))]
    scaled = lambda df: df.withColumns({z: (F.col(f) - m[f"m_{i}"]) / (m[f"s_{i}"] or 1.0) for i, (z, f) in enumerate(zip(names, features))})
    vector = VectorAssembler(inputCols=names, outputCol="tail_x")
    fit = LogisticRegression(featuresCol="tail_x", labelCol=label, regParam=1 / (c * m["n"]), standardization=False, maxIter=200, tol=1e-10, predictionCol="", rawPredictionCol="", probabilityCol="tail_p")
    model = fit.fit(vector.transform(scaled(known)))
    whole = model.transform(vector.transform(scaled(rows.where(complete)))).withColumn("probability", vector_to_array("tail_p")[1]).select(*rows.columns, "probability")
    return whole.unionByName(rows.where(~complete).withColumn("probability", F.lit(None).cast("double")))
