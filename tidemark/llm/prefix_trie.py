"""Conversation prefix trie by vertical bitmaps: which conversations share their first turns, how many tokens sharing saves, and where conversations end.

Conversations are numbered by id and dealt into shards of `SHARD` consecutive ones. A shard indexes each (position, turn) to the bitset of its conversations, walks depth first from the
start, and gets a node's children by intersecting its bitset with the postings at its depth: the lowest conversation that is left names the next posting, its intersection is the child, and so on
until none is left. Popcounts are the members, and the ones that have no turn left are the end list.

A node is known in all shards by its depth and the exclusive or of 128 bits of SHA-256 over (position, turn) of its prefix, so a shard need not begin at the root: a conversation of more than `BLOCK` turns
is cut into blocks of positions, each dealt on its own with the node that it starts from. Shards' nodes are then merged: members and ends add up, the smallest member is the least of the shards'.
Sums over subtrees come from pointer doubling, where a node hands its sum to the ancestor at distance 1, 2, 4 and so on: rounds grow with the logarithm of the depth that conversations share, as a
node of one member has one leaf and saves nothing. End lists are hashed in order of the shards, streaming, one chunk of a shard at a time.

Positions come from `numbered`, so that no conversation, however long, meets in one task; a first turn or a whole conversation that very many share is one row a shard.

Cases: rows with a null conversation id take no part; null roles and texts are empty; turns with equal numbers are ordered by role and text's digest; a conversation without a turn left (by the
rule of `rebuilt`) is a member of the root and ends there; repeated rows are turns of their own; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import crc32_sql, discard, named, numbered, staged, staged_at

#: Conversations of a shard; positions of a block.
SHARD, BLOCK = 2_048, 256
NODES = T.StructType(
    [
        T.StructField("node", T.BinaryType()),
        T.StructField("depth", T.LongType()),
        T.StructField("parent", T.BinaryType()),
        T.StructField("n_convs", T.LongType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("points", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("ends", T.StringType()),
    ]
)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, digest (of role and text, told apart by the role's length), points (code points of the text) of every row with a conversation id."""
    role, text = (F.coalesce(named(c), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.where(named(conv_col).isNotNull()).select(named(conv_col).cast("long").alias("conv_id"), named(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("points"))


def placed(rows: DataFrame) -> tuple[DataFrame, str]:
    """conv_id, pos (from 0), digest, points, n (turns of the conversation), and their folder."""
    found, path = numbered(rows, "conv_id", ["turn", "digest"], "conversation-turns")
    return found.select("conv_id", F.col("number").alias("pos"), "digest", "points", F.col("size").alias("n")), path


def rebuilt(own: DataFrame) -> DataFrame:
    """The turns of rebuilt conversations: the first h of conversation c - c % 100, then c's own after its first h; h is the crc32 of c as decimal text, modulo 6. `own`: as from `placed`."""
    h = F.expr("crc32(cast(cast(conv_id as string) as binary)) % 6")
    convs = own.where("pos = 0").select("conv_id", F.expr("conv_id - conv_id % 100").alias("base"), h.alias("h"))
    bases = own.where("pos < 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("b"), "pos", "digest", "points", F.col("n").alias("b_n"))
    first = convs.join(bases, (F.col("base") == F.col("b")) & (F.col("pos") < F.col("h"))).select("conv_id", "pos", "digest", "points")
    kept = bases.where("pos = 0").select("b", "b_n")
    rest = own.where(F.col("pos") >= h).withColumn("base", F.expr("conv_id - conv_id % 100")).join(kept, F.col("base") == F.col("b"), "left")
    return first.unionByName(rest.select("conv_id", (F.col("pos") - h + F.least(h, F.coalesce("b_n", F.lit(0)))).alias("pos"), "digest", "points"))


def step_of(pos: int, digest: bytes) -> int:
    """What a turn at a position adds to its node, as 128 bits."""
    return int.from_bytes(hashlib.sha256(b"%d:" % pos + digest).digest()[:16], "big")


def _steps(rows: DataFrame) -> DataFrame:
    """conv_id, pos, step (16 bytes), points."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = [step_of(p, d.encode()) for p, d in zip(b.column("pos").to_pylist(), b.column("digest").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("conv_id"), b.column("pos"), pa.array([x.to_bytes(16, "big") for x in steps], pa.binary()), pa.array([x >> 64 for x in steps], pa.uint64()).view(pa.int64()), pa.array([x & (1 << 64) - 1 for x in steps], pa.uint64()).view(pa.int64()), b.column("points")], names=["conv_id", "pos", "step", "high", "low", "points"])

    return rows.select("conv_id", "pos", "digest", "points").mapInArrow(of, "conv_id long, pos long, step binary, high long, low long, points long")


def walk(convs: np.ndarray, start: list[int], base: int, sizes: np.ndarray, steps: list[list[int]], points: list[list[int]], ended: np.ndarray, top: bool) -> Iterator[tuple]:
    """The nodes of one shard, without the ones that it starts from unless `top`: (node, depth, parent, members, least conversation, points of the last turn, ending conversations).

    `convs` ascend; conversation i starts from node `start[i]` at depth `base` and has `sizes[i]` steps here; `ended[i]`: it goes on in no later block.
    """
    postings: dict[tuple[int, int], int] = {}
    roots: dict[int, int] = {}
    for i, own in enumerate(steps):
        bit = 1 << i
        roots[start[i]] = roots.get(start[i], 0) | bit
        for k, s in enumerate(own):
            postings[k, s] = postings.get((k, s), 0) | bit
    ends_at = [0] * (int(sizes.max(initial=0)) + 1)
    for i in np.flatnonzero(ended).tolist():
        ends_at[sizes[i]] |= 1 << i
    longer = [0] * (len(ends_at) + 1)  # conversations with more than k steps
    for k in range(len(ends_at) - 1, 0, -1):
        longer[k - 1] = longer[k]
        for i in np.flatnonzero(sizes == k).tolist():
            longer[k - 1] |= 1 << i

    def members(bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(int(convs[low.bit_length() - 1]))
            bits ^= low
        return out

    todo: list[tuple[int, int, int]] = []
    for node, bits in roots.items():
        if top:
            yield node, base, None, bits.bit_count(), int(convs[(bits & -bits).bit_length() - 1]), 0, members(bits & ends_at[0])
        todo.append((node, 0, bits))
    while todo:
        node, k, bits = todo.pop()
        left = bits & longer[k]
        while left:
            first = (left & -left).bit_length() - 1
            s = steps[first][k]
            child = left & postings[k, s]
            left ^= child
            yield node ^ s, base + k + 1, node, child.bit_count(), int(convs[first]), points[first][k], members(child & ends_at[k + 1])
            if child & longer[k + 1]:
                todo.append((node ^ s, k + 1, child))


def local_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Each shard's nodes (NODES). `rows`: from `_steps`, `convs`: conv_id, shard of every conversation, turns or not."""
    blocks = rows.groupBy("conv_id", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.bit_xor("high").alias("high"), F.bit_xor("low").alias("low"), F.count(F.lit(1)).alias("size"))
    blocks = convs.select("conv_id", "shard").join(blocks, "conv_id", "left").withColumn("block", F.coalesce("block", F.lit(0)))
    before = Window.partitionBy("conv_id").orderBy("block")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select(
        "conv_id", "shard", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("step"), F.coalesce(F.bit_xor("high").over(earlier), F.lit(0)).alias("high"),
        F.coalesce(F.bit_xor("low").over(earlier), F.lit(0)).alias("low"), F.lead("block").over(before).isNull().cast("long").alias("points"),
    )
    body = rows.join(convs.select("conv_id", "shard"), "conv_id").select("conv_id", "shard", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "step", "high", "low", "points")
    both = heads.unionByName(body).repartition("shard", "block").sortWithinPartitions("shard", "block", "conv_id", "pos")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def finish() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            shard, block = last
            pos, conv, points, step = t.column("pos").to_numpy(), t.column("conv_id").to_numpy(), t.column("points").to_numpy(), t.column("step").to_pylist()
            head = np.flatnonzero(pos < 0)
            cuts = [*head.tolist(), len(pos)]
            high, low = (t.column(c).to_numpy().view(np.uint64)[head].tolist() for c in ("high", "low"))
            steps = [[int.from_bytes(x, "big") for x in step[a + 1 : b]] for a, b in zip(cuts, cuts[1:], strict=False)]
            values = [points[a + 1 : b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
            found = walk(conv[head], [h << 64 | l for h, l in zip(high, low, strict=True)], block * BLOCK, np.diff(cuts) - 1, steps, values, points[head] > 0, block == 0)
            out = []
            for node, depth, parent, n, least, own, ends in found:
                out.append((node.to_bytes(16, "big"), depth, None if parent is None else parent.to_bytes(16, "big"), n, least, own, shard, ",".join(map(str, ends)) if ends else None))
                if len(out) == 4096:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, block = batch.column("shard").to_numpy(), batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                this = int(shard[lo]), int(block[lo])
                if this != last and held:
                    yield from finish()
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = this
        if held:
            yield from finish()

    return both.mapInArrow(of, NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NODES.names)


def _end_hashes(local: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes where conversations end: chunks of shards in order, streamed through one SHA-256 a node."""
    chunks = local.where("ends is not null").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            done = []
            for node, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if node == last:
                    state.update(b"," + ends.encode())
                    continue
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = node, hashlib.sha256(ends.encode())
            yield pa.record_batch([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["node", "ends_sha256"])
        if last is not None:
            yield pa.record_batch([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return chunks.mapInArrow(of, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> tuple[DataFrame, str]:
    """`nodes` (node, parent, and whole numbers `values`) with each value summed over the node's subtree, itself included; and their folder.

    Round k adds what lies 2 ** k to 2 ** (k + 1) - 1 levels below, and lets the pointer skip twice as far; rounds end when every pointer is past the root.
    """
    state, path = staged_at(nodes.select("node", F.col("parent").alias("up"), *values), "trie-sums")
    while state.where("up is not null").limit(1).count():
        from_below = state.where("up is not null").groupBy(F.col("up").alias("n")).agg(*(F.sum(v).alias(f"more_{v}") for v in values))
        further = state.select(F.col("node").alias("p"), F.col("up").alias("next"))
        grown = state.join(from_below, F.col("node") == F.col("n"), "left").join(further, F.col("up") == F.col("p"), "left")
        summed = grown.select("node", F.col("next").alias("up"), *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values))
        state, new = staged_at(summed, "trie-sums")
        discard(nodes.sparkSession, path)
        path = new
    return state.drop("up"), path


def trie(conversation_turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node (hex).

    `conversation_turns`: conv_id, pos (from 0, without gaps), digest, points; `conversations`: conv_id of every conversation, with turns or without.
    """
    spark = conversations.sparkSession
    ids, ids_at = numbered(conversations.select("conv_id", F.lit(0).alias("one")), "one", ["conv_id"], "conversation-ids")
    convs, convs_at = staged_at(ids.select("conv_id", F.expr(f"number div {SHARD}").alias("shard")), "conversation-shards")
    rows, rows_at = staged_at(_steps(conversation_turns), "conversation-steps")
    local, local_at = staged_at(local_nodes(rows, convs), "trie-shards")
    for path in (ids_at, convs_at, rows_at):
        discard(spark, path)
    merged = local.groupBy("node", "depth", "parent").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("points").alias("points"))
    merged, merged_at = staged_at(merged, "trie-merged")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("c_of")).agg(F.count(F.lit(1)).alias("n_children"), F.sum(F.expr("if(n_convs = 1, 1, 0)")).alias("alone"))
    nodes = merged.join(children, F.col("node") == F.col("c_of"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "alone")})
    # A node of one member is a chain to its end: one leaf, nothing saved. The others add up what they save, the chains below them and their own end if they have no child.
    shared = nodes.where("n_convs > 1").select("node", "parent", F.expr("alone + if(n_children = 0, 1, 0)").alias("n_leaves"), F.expr("(n_convs - 1) * points").alias("saved_tokens"))
    sums, sums_at = subtree_sums(shared, ["n_leaves", "saved_tokens"])
    parents = merged.select(F.col("node").alias("p_node"), F.col("conv_id").alias("parent_conv_id"))
    sums, ends = sums.withColumnRenamed("node", "s_node"), _end_hashes(local).withColumnRenamed("node", "e_node")
    out = nodes.join(parents, F.col("parent") == F.col("p_node"), "left").join(sums, F.col("node") == F.col("s_node"), "left").join(ends, F.col("node") == F.col("e_node"), "left")
    out = out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.lower(F.hex("node")).alias("node"),
    )
    result = staged(out, "trie")
    for path in (local_at, merged_at, sums_at):
        discard(spark, path)
    return result


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    own, path = placed(turns(conversations))
    own = own.where("conv_id is not null")
    found = trie(rebuilt(own), own.where("pos = 0").select("conv_id"))
    discard(conversations.sparkSession, path)
    return found.drop("node")


ORACLE_SQL = f"""
WITH o AS MATERIALIZED (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS td, length(coalesce(text, '')) AS points, turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT DISTINCT c, c - c % 100 AS base, {crc32_sql("c")} % 6 AS h FROM o),
turns AS (
  SELECT convs.c, 0 AS part, o.pos, td, points FROM convs JOIN o ON o.c = convs.base AND o.pos < convs.h
  UNION ALL SELECT convs.c, 1, o.pos, td, points FROM convs JOIN o ON o.c = convs.c AND o.pos >= convs.h),
whole AS MATERIALIZED (SELECT convs.c, coalesce(list(td ORDER BY part, pos) FILTER (td IS NOT NULL), []) AS tds, coalesce(list(points ORDER BY part, pos) FILTER (td IS NOT NULL), []) AS ps FROM convs LEFT JOIN turns ON turns.c = convs.c GROUP BY convs.c),
m AS MATERIALIZED (SELECT c, d, array_to_string(tds[1:d], '') AS node, array_to_string(tds[1:d - 1], '') AS parent, CASE WHEN d > 0 THEN ps[d] ELSE 0 END AS points, len(tds) = d AS ends FROM (SELECT *, unnest(range(0, len(tds) + 1)) AS d FROM whole)),
n AS MATERIALIZED (
  SELECT node, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(points) AS points, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ends FROM m GROUP BY node, d),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS MATERIALIZED (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.parent = n.node AND kids.d = n.d),
below AS (
  SELECT f.node, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.points)::BIGINT AS saved_tokens
  FROM f JOIN (SELECT node, n_children, n_convs, points, unnest(range(0, d + 1)) AS up FROM f) x ON x.node[1:64 * x.up] = f.node AND f.d = x.up GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves, below.saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN below ON below.node = f.node LEFT JOIN n p ON f.d > 0 AND p.node = f.parent AND p.d = f.d - 1
"""
