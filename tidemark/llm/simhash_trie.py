"""SimHash near-duplicates: 64-bit fingerprints joined by a binary trie self-join, then grouped into components.

The trie: at most `budget` = 3 of 64 bits differ, so of four 16-bit blocks one is equal. Each distinct fingerprint is placed in four
tries, one per block, with that block's bits on top. Below an equal top block the trie is joined with itself: node pairs are
walked together, a pair of children on different sides adds one differing bit, and a pair is dropped once more than `budget` bits
differ. A block value shared by very many fingerprints is cut into slices and the pairs of slices become separate groups, so no task
holds an unbounded group and nothing is dropped. Tasks emit a spanning forest of the links they find, never all pairs.
Components of these links come from alternating large-star and small-star rounds, each written to the shared folder and deleted when the next one is.

Cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle are one shingle;
repeated ids are rows of their own; a null id never is a component's id unless it has no other; an empty table gives an empty result.
`near_duplicates` reads only the id and the text; `drop_near_duplicates` leaves exactly one row a component (the smallest id, null ids last, then the first row read)
and carries other columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import columns_of, discard, fresh, give_back, named, shards, staged, staged_at, with_arrow_column

SHINGLE, BUDGET, SEED = 3, 3, 42
#: Fingerprints of one block value that a group holds at most; more are cut into slices of about this size.
SLICE = 50_000
#: Rows of the four tries that a task gets on average.
TASK_ROWS = 200_000
#: Pairs of a leaf that are compared at once, and node pairs that are opened at once.
LEAF_PAIRS, FRONT = 1 << 20, 1 << 17


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return int(np.uint64(xxh64_intdigest(joined, SEED)).astype(np.int64))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes - 1
    n = len(words) - width + 1
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    set_ = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        set_ += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str, out: str, width: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """`docs` with the fingerprint of every row's text as last column `out` (long); without the text on request."""

    def of(texts: pa.Array) -> pa.Array:
        prints = pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())
        give_back()
        return prints

    return with_arrow_column(docs, text_col, lambda: of, out, T.LongType(), keep_text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) for every row."""
    return with_fingerprint(docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")), "text", "fp", width, keep_text=False)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of ragged ranges, and which range each belongs to."""
    size = hi - lo
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size), which


class _Forest:
    """Union-find over positions, many unions at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots()[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def trie_links(keys: np.ndarray, pairs: list[tuple[int, int, int, int]], top: int, budget: int) -> np.ndarray:
    """Joins tries over `keys` (unsigned 64-bit, sorted within each range) and gives for each position a linked position that is not after it.

    `pairs`: pairs of position ranges (a_lo, a_hi, b_lo, b_hi), each the root of a trie whose first `top` bits are equal; a range paired
    with itself is a self-join. Positions in one answer's chain are connected by links of at most `budget` differing bits.
    At most `FRONT` node pairs are opened together, deepest first, so that what waits is bounded by the depth of the tries and not by the number of pairs.
    """
    forest = _Forest(len(keys))
    ones: dict[int, np.ndarray] = {}
    start = np.array(pairs, np.int64).reshape(-1, 4)
    todo = [(top, start, np.zeros(len(start), np.int8))]
    while todo:
        depth, front, errors = todo.pop()
        if len(front) > FRONT:
            todo.append((depth, front[FRONT:], errors[FRONT:]))
            front, errors = front[:FRONT], errors[:FRONT]
        size = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        leaf = (size <= 64) | (depth == 64)
        order = np.flatnonzero(leaf)
        cuts = np.searchsorted(np.cumsum(size[order]), np.arange(LEAF_PAIRS, int(size[order].sum()) + LEAF_PAIRS, LEAF_PAIRS))
        for some in np.split(order, np.unique(cuts)):
            _compare(keys, front[some], budget, forest)
        front, errors = front[~leaf], errors[~leaf]
        if depth == 64 or not len(front):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int32))).astype(np.int32)
        one = ones[depth]
        a_lo, a_hi, b_lo, b_hi = front.T
        a_mid, b_mid = a_hi - (one[a_hi] - one[a_lo]), b_hi - (one[b_hi] - one[b_lo])
        same = (a_lo == b_lo) & (a_hi == b_hi)
        grown = [
            (np.stack([a_lo, a_mid, b_lo, b_mid], 1), errors),
            (np.stack([a_mid, a_hi, b_mid, b_hi], 1), errors),
            (np.stack([a_lo, a_mid, b_mid, b_hi], 1), errors + 1),
            (np.stack([a_mid, a_hi, b_lo, b_mid], 1)[~same], errors[~same] + 1),
        ]
        below, off = np.concatenate([x for x, _ in grown]), np.concatenate([e for _, e in grown])
        live = (off <= budget) & (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3])
        if live.any():
            todo.append((depth + 1, below[live], off[live]))
    return forest.roots()


def _compare(keys: np.ndarray, ranges: np.ndarray, budget: int, forest: _Forest) -> None:
    a, which = _expand(ranges[:, 0], ranges[:, 1])
    b, of = _expand(ranges[which, 2], ranges[which, 3])
    a = a[of]
    near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
    near &= a != b
    forest.union(a[near], b[near])


def _turned(fp: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The fingerprints with block 0 to 3 (from the high end) turned to the top."""
    shift = (block * 16).astype(np.uint64)
    back = np.where(block == 0, np.uint64(0), fp >> ((np.uint64(64) - shift) % np.uint64(64)))
    return (fp << shift) | back


def _task_links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """One partition: rows (fp, block, value, low, high, slice). Holds its partition, whose size the number of partitions bounds."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    fp, block, low, high, own = (t.column(c).to_numpy() for c in ("fp", "block", "low", "high", "slice"))
    turned = _turned(fp.view(np.uint64), block.astype(np.int64))
    value = turned >> np.uint64(48)
    order = np.lexsort((turned, own, high, low, value, block))
    fp, block, low, high, own, turned, value = (x[order] for x in (fp, block, low, high, own, turned, value))
    new = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(value) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)])
    pairs = []
    for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(fp)], strict=True):
        if low[lo] == high[lo]:
            if hi - lo > 1:
                pairs.append((lo, hi, lo, hi))
        else:
            mid = lo + int(np.searchsorted(own[lo:hi], high[lo]))
            if lo < mid < hi:
                pairs.append((lo, mid, mid, hi))
    root = trie_links(turned, pairs, 16, budget)
    linked = np.flatnonzero(root != np.arange(len(root)))
    yield pa.record_batch([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["u", "v"])


def links(distinct: DataFrame, n: int, budget: int = BUDGET, slice_rows: int = SLICE) -> DataFrame:
    """Links (u, v) that connect exactly the fingerprints at `budget` (3 at most) or fewer differing bits, directly or by others.

    `distinct`: one row per fingerprint, column fp; `n`: their number.
    """
    if not 0 <= budget <= 3:
        raise ValueError("four blocks find at most 3 differing bits")
    placed = distinct.select("fp", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("block"))
    placed = placed.withColumn("value", F.expr("cast(shiftrightunsigned(fp, 48 - 16 * block) & 65535 as int)"))
    crowded = placed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > slice_rows)
    crowded = crowded.select(F.col("block").alias("c_block"), F.col("value").alias("c_value"), F.ceil(F.col("rows") / slice_rows).cast("int").alias("slices"))
    cut = placed.join(crowded, (F.col("block") == F.col("c_block")) & (F.col("value") == F.col("c_value")), "left").select(
        "fp", "block", "value", F.coalesce("slices", F.lit(1)).alias("slices"), F.expr("cast(pmod(xxhash64(fp), coalesce(slices, 1)) as int)").alias("slice")
    )
    dealt = cut.withColumn("other", F.explode(F.expr("sequence(0, slices - 1)"))).select(
        "fp", "block", "value", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "slice"
    )
    tasks = shards(4 * n, TASK_ROWS)
    return dealt.repartition(max(tasks, _parallelism(distinct)), "block", "value", "low", "high").mapInArrow(lambda batches: _task_links(batches, budget), "u long, v long")


def _parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v) but the roots: root is the smallest node that can be reached.

    Alternating large-star and small-star rounds; each round's edges are written to the shared folder, and rounds end when nothing changes.
    """
    edges, path = staged_at(edges.where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = down.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("k", "m")).distinct()
        edges, new = staged_at(small, "links")
        discard(edges.sparkSession, path)
        path = new
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def classes_of(prints: DataFrame, budget: int) -> DataFrame:
    """fp, root of every distinct fingerprint of `prints` (written: it is read more than once)."""
    distinct = staged(prints.select("fp").distinct(), "classes")
    found = components(links(distinct, distinct.count(), budget))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id of the component) for every row."""
    prints = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    rooted = staged(classes_of(prints, budget), "rooted")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    ids = least.join(rooted, F.col("fp") == F.col("f")).groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"))
    of_class = rooted.join(ids, F.col("root") == F.col("r")).select("f", "component_id")
    return prints.join(of_class, F.col("fp") == F.col("f")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of each component, with all its columns. Rows get a key of their own, written with them, so that repeated and null ids are told apart."""
    fp, key = fresh(docs, "fingerprint"), fresh(docs, "row_key")
    rows = staged(with_fingerprint(docs, text_col, fp, width).withColumn(key, F.monotonically_increasing_id()), "fingerprinted")
    prints = rows.select(named(id_col).alias("id"), named(fp).alias("fp"), named(key).alias("key"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    least = prints.groupBy("fp").agg(first)
    kept = least.join(classes_of(prints, budget), F.col("fp") == F.col("f")).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("kept_key"))
    return rows.join(kept, named(key) == F.col("kept_key"), "left_semi").select(*columns_of(docs))
