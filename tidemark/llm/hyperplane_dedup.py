"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine verification, distributed connected components.

Equal vectors of a label become one class first, with a count. A class gets, in each of T tables, the signs of its vector against b random hyperplanes; classes of a label meet where a table gives
them the same signs, and every pair that meets is verified by its cosine in double precision. Two vectors at the cosine `least` agree in one sign with probability 1 - angle / pi, so T is chosen from
b such that a pair at exactly that cosine is missed in all tables with probability `miss` at most; nearer pairs are missed far more rarely. b grows with the largest label (a bucket has about
`BUCKET` unrelated classes).

A pair may meet in several tables and counts in the first: tasks know the signs of all tables. Links are counted where they are found (partial counts by class) and joined by a spanning forest for each
bucket, so pairs are never emitted. A bucket with more than `SLICE` classes is cut into slices whose pairs are groups of their own, so no task holds an unbounded group and nothing is dropped; tiles of
a group whose rows have all met in an earlier table are skipped, so a dense cluster is compared about once.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing and are components of their own; vectors of different lengths are never linked;
rows that repeat an id are rows of their own, linked by their vectors; a null id is a component's id only where it has no other; ties do not arise (a link depends on its two vectors alone);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, named, staged, staged_at
from tidemark.llm.simhash_trie import _Forest, components

LEAST, MISS, SEED = 0.93, 1e-4, 42
#: Classes of one bucket and unrelated ones that it should have at most; bits of a table.
BUCKET, BITS = 2_048, (8, 30)
#: Classes of a bucket that a group holds; larger buckets are cut. Rows and columns of a tile of cosines.
SLICE, TILE = 8_192, 512


def plan(largest: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """(b, T): signs of a table and tables for a largest label of so many classes."""
    bits = min(BITS[1], max(BITS[0], math.ceil(math.log2(max(1, largest) / BUCKET))))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def signs(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """For each row of `x` the `bits` signs in each table as one integer."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    positive = (x @ planes > 0).reshape(len(x), tables, bits)
    return (positive << np.arange(bits)).sum(2).astype(np.int32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows to rows, summed from the first component to the last in double precision."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / np.sqrt(aa * bb)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; the largest component is made one first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def bucket_links(x: np.ndarray, sig: np.ndarray, many: np.ndarray, table: int, split: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the classes of one group that first meet in `table`: for each row the number of linked vectors, and a linked row that is not after it (by others, perhaps).

    `split`: 0 to compare all rows with each other, else the first `split` rows with the rest. Rows are sorted by their signs in the tables before, so that those which have met are neighbours.
    """
    n, forest, counts = len(x), _Forest(len(x)), np.zeros(len(x), np.int64)
    unit = _unit(x)
    sides = [(0, n, 0, n)] if not split else [(0, split, split, n)]
    low = [(s.min(0), s.max(0)) for at in range(0, n, TILE) if len(s := sig[at : at + TILE, :table])] if table and not split else []
    for a_lo, a_hi, b_lo, b_hi in sides:
        for i in range(a_lo, a_hi, TILE):
            for j in range(b_lo if split else i, b_hi, TILE):
                i_to, j_to = min(i + TILE, a_hi), min(j + TILE, b_hi)
                if table:
                    (p, q), (r, s) = (low[i // TILE], low[j // TILE]) if low else ((sig[i:i_to, :table].min(0), sig[i:i_to, :table].max(0)), (sig[j:j_to, :table].min(0), sig[j:j_to, :table].max(0)))
                    if ((p == q) & (q == r) & (r == s)).any():
                        continue  # all of these have met in one earlier table
                near = unit[i:i_to] @ unit[j:j_to].T
                a, b = np.nonzero(near >= least - 1e-9)
                close = near[a, b] < least + 1e-9
                a, b = a + i, b + j
                ok = a < b
                edge = np.flatnonzero(ok & close)
                ok[edge] = cosines(x[a[edge]], x[b[edge]]) >= least
                a, b = a[ok], b[ok]
                for at in range(0, len(a), 1 << 18):
                    u, v = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
                    for t in range(table):
                        if not len(u):
                            break
                        new = sig[u, t] != sig[v, t]
                        u, v = u[new], v[new]
                    np.add.at(counts, u, many[v])
                    np.add.at(counts, v, many[u])
                    forest.union(u, v)
    return counts, forest.roots()


def usable(v: Column) -> Column:
    """Whether a vector (array<double>) takes part."""
    infinite = F.lit(float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists(v, lambda x: x != 0)


def _rows(batch: pa.RecordBatch, column: str, dtype: str) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    width = len(batch.column(column)[0])
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(batch.num_rows, width)


def _with_signs(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            sig = np.zeros((batch.num_rows, tables), np.int32)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                sig[at] = signs(_unit(_rows(batch.take(pa.array(at)), "v", "f8")), bits, tables)
            yield batch.append_column("sig", pa.ListArray.from_arrays(np.arange(0, sig.size + 1, tables, dtype=np.int32), pa.array(sig.ravel())))

    return classes.mapInArrow(of, _schema(classes, "sig array<int>"))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def links(classes: DataFrame, least: float = LEAST, slice_rows: int = SLICE) -> DataFrame:
    """Partial results (key, links, root) of the classes (key, label, dim, v, many, sig): numbers of linked vectors, to be summed by class, and links of a spanning forest."""
    group = ["label", "dim", "tab", "signs"]
    sizes = classes.select("label", "dim", F.posexplode("sig").alias("tab", "signs")).groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    crowded = sizes.where(F.col("rows") > slice_rows).select(*(F.col(c).alias(f"g_{c}") for c in group), F.ceil(F.col("rows") / slice_rows).cast("int").alias("cut"))
    crowded = staged(crowded, "embedding-crowded")  # written, so that Spark knows its size and broadcasts it only if it is small
    placed = classes.select("key", "label", "dim", "v", "many", "sig", F.posexplode("sig").alias("tab", "signs")).withColumn("sig", F.slice("sig", F.lit(1), F.col("tab")))
    met = placed.join(crowded, [F.col(c) == F.col(f"g_{c}") for c in group], "left").withColumn("slices", F.coalesce("cut", F.lit(1)))
    dealt = met.withColumn("slice", F.expr("cast(pmod(xxhash64(key), slices) as int)")).withColumn("other", F.explode(F.expr("sequence(0, slices - 1)"))).select(
        *group, F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "slice", "key", "many", "v", "sig"
    )
    by = [*group, "low", "high"]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by, "slice", "sig", "key")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def finish() -> pa.RecordBatch:
            some = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            side, low, high = (some.column(c).to_numpy() for c in ("slice", "low", "high"))
            split = 0 if low[0] == high[0] else int(np.searchsorted(side, high[0]))
            key = some.column("key").to_numpy()
            if len(key) < 2 or (low[0] != high[0] and split in (0, len(key))):
                return pa.record_batch([key[:0], key[:0], key[:0]], names=["key", "links", "root"])
            counts, root = bucket_links(_rows(some, "v", "f8"), _rows(some, "sig", "i4"), some.column("many").to_numpy(), int(some.column("tab")[0].as_py()), split, least)
            found = np.flatnonzero(counts)
            return pa.record_batch([key[found], counts[found], key[root[found]]], names=["key", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table({c: batch.column(c) for c in by})
            cuts = [0, *_changes(table), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                this = tuple(batch.column(c)[lo].as_py() for c in by)
                if this != last and held:
                    yield finish()
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = this
        if held:
            yield finish()

    return dealt.mapInArrow(of, "key long, links long, root long")


def _changes(table: pa.Table) -> list[int]:
    """Positions at which a row differs from the one before it."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for c in table.columns:
        codes = c.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return (np.flatnonzero(new) + 1).tolist()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, miss: float = MISS, slice_rows: int = SLICE) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept, for every row."""
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # floats travel as floats
    v = F.transform(named(vector_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))  # no negative zero
    rows = vectors.select(named(id_col).alias("vec_id"), named(label_col).alias("label"), v.alias("v"))
    takes_part = F.coalesce(usable(F.col("v")) & F.col("label").isNotNull(), F.lit(False))
    content = F.sha2(F.to_json(F.struct("v")).cast("binary"), 256)
    rows = staged(rows.withColumn("digest", F.when(takes_part, content)), "embeddings")
    classes = rows.where("digest is not null").groupBy("label", F.size("v").alias("dim"), "digest", "v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("many"))
    classes, classes_at = staged_at(classes.withColumn("key", F.monotonically_increasing_id()), "embedding-classes")
    bits, tables = plan(classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0, least, miss)
    signed, signed_at = staged_at(_with_signs(classes.select("key", "label", "dim", "v", "many"), bits, tables), "embedding-signs")
    found, found_at = staged_at(links(signed, least, slice_rows), "embedding-links")
    spark = vectors.sparkSession
    discard(spark, signed_at)
    roots = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    rooted = classes.select("key", "label", "dim", "digest", "first_id", "many").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    least_id = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"))
    linked = found.groupBy(F.col("key").alias("k")).agg(F.sum("links").alias("links"))
    of_class = rooted.join(least_id, F.col("root") == F.col("r")).join(linked, F.col("key") == F.col("k"), "left")
    of_class = staged(of_class.select(F.col("label").alias("c_label"), F.col("digest").alias("c_digest"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"), "embedding-results")
    discard(spark, found_at)
    discard(spark, classes_at)
    out = rows.select("vec_id", "label", "digest").join(of_class, (F.col("label") == F.col("c_label")) & (F.col("digest") == F.col("c_digest")), "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER () AS r,
    coalesce(label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.ok AND b.ok AND a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {LEAST}),
reach AS (SELECT r AS a, r AS b FROM e UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.b GROUP BY ALL)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.r) AS n_links, c.component_id, e.vec_id IS NOT DISTINCT FROM c.component_id AS kept FROM e JOIN c ON c.r = e.r
"""
