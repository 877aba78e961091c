"""Merkle manifest of a dataset: trees of fan-out 8 over the rows of each group and over the groups, with proofs by checkpoint and recompute. Native.

Only the leaves and every `STEP`-th level above them are persisted. A stored row is an aligned subtree: the up to 8 ** STEP nodes of one checkpoint level that share an ancestor
at the next one. Building goes up: a subtree's top is hashed from its stored nodes, and the levels between are not kept. Proofs go down: each subtree gets the siblings on the way from
its top to the root by a join with one row a subtree, regenerates its missing interior nodes from its stored ones, gives every node its siblings in them, and drops them again.
A subtree has 64 nodes at most, whatever the size of a group, and positions come from `numbered`, so a group that holds most rows is spread like any other.

Cases: a null in a field is `-`, apart from any value; null groups are a group, before all others; rows with a null id come first in their group; rows that repeat an id are leaves of
their own, by digest; a group of one row has its leaf as subroot, one group its subroot as root; an empty table has no root (null) and no proofs; other columns are
not read, those to carry may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_sql, discard, id_bucket, named, numbered, staged_at

FANOUT, STEP = 8, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"
PATH = "array<struct<left:string,right:string>>"


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as `-` if null, else its UTF-8 bytes, `:` and its value, so that no two rows read alike."""
    texts = [f.cast("string") for f in fields]
    return digest_of(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _above(nodes: Column) -> Column:
    """The level above `nodes`, which begin at a run: each run of 8 (the last: fewer, even one) becomes its digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "").cast("binary"), 256))


def _count(level: int) -> Column:
    """Nodes of the tree at a level."""
    return F.expr(f"(n + {FANOUT**level - 1}) div {FANOUT**level}")


@dataclass
class Tree:
    """Stored levels of the trees of all groups: `levels[i]` has the nodes of level i * step as rows (g, n, sub, nodes), a row an aligned subtree; `tops` (g, n, digest) a row a group."""

    step: int
    levels: list[DataFrame]
    tops: DataFrame
    folders: list[str]


@dataclass
class Manifest:
    """`rows`: the tree of each group of rows; `groups`: the tree over the subroots; `root`: null for an empty table."""

    rows: Tree
    groups: Tree
    root: str | None

    def discard(self, spark: SparkSession) -> None:
        """Deletes the stored levels."""
        for path in [*self.rows.folders, *self.groups.folders]:
            discard(spark, path)


def _levels(subtree: DataFrame, level: int, step: int) -> list[tuple[Column, DataFrame]]:
    """The frame with columns lv0 .. lv<step>: the nodes of a stored row and the levels above them up to its top; where the tree has ended, the last node stays."""
    subtree = subtree.withColumn("lv0", F.transform("nodes", lambda x: x["digest"]))
    for i in range(step):
        subtree = subtree.withColumn(f"lv{i + 1}", F.when(_count(level + i) > 1, _above(F.col(f"lv{i}"))).otherwise(F.col(f"lv{i}")))
    return subtree


def _grow(leaves: DataFrame, name: str, step: int) -> Tree:
    """`leaves`: g, n (rows of g), idx (from 0), digest, row (any struct to carry)."""
    wide, level, levels, folders = FANOUT**step, 0, [], []
    most = None
    while True:
        node = F.struct("idx", "digest", *(["row"] if level == 0 else []))
        grouped = leaves.groupBy("g", "n", F.expr(f"idx div {wide}").alias("sub")).agg(F.sort_array(F.collect_list(node)).alias("nodes"))
        stored, path = staged_at(grouped, f"merkle-{name}-level{level}")
        levels.append(stored)
        folders.append(path)
        if most is None:
            most = stored.agg(F.max("n")).first()[0] or 0
        above = _levels(stored, level, step).select("g", "n", F.col("sub").alias("idx"), F.get(F.col(f"lv{step}"), F.lit(0)).alias("digest"))
        level += step
        if -(-most // FANOUT**level) <= 1:
            return Tree(step, levels, above.select("g", "n", "digest"), folders)
        leaves = above


def build(rows: DataFrame, group: str, id_col: str, digest: str, carry: list[str] | None = None, step: int = STEP) -> Manifest:
    """The manifest of `rows`, whose leaves are in column `digest`; the columns `carry` ride with their leaves to the proofs."""
    if step < 1:
        raise ValueError("step is 1 or more")
    carried = F.struct(named(id_col).alias("id"), *(named(c).alias(f"c{i}") for i, c in enumerate(carry or [])))
    leaves = rows.select(named(group).alias("g"), named(id_col).alias("id"), named(digest).alias("digest"), carried.alias("row"))
    placed, path = numbered(leaves, "g", ["id", "digest"], "merkle-leaves")
    tree = _grow(placed.select("g", F.col("size").alias("n"), F.col("number").alias("idx"), "digest", "row"), "rows", step)
    discard(rows.sparkSession, path)
    one = tree.tops.select(F.lit(0).alias("one"), F.col("g").alias("lang"), "digest", F.struct(F.col("g").alias("id")).alias("row"))
    placed, path = numbered(one, "one", ["lang"], "merkle-groups")
    over = _grow(placed.select(F.col("one").alias("g"), F.col("size").alias("n"), F.col("number").alias("idx"), "digest", "row"), "groups", step)
    discard(rows.sparkSession, path)
    top = over.tops.first()
    return Manifest(tree, over, top["digest"] if top else None)


def _descend(tree: Tree, paths: DataFrame) -> DataFrame:
    """Every leaf's path. `paths`: g, idx (0), path (from the group's top to the root), extra (any struct)."""
    for i in reversed(range(len(tree.levels))):
        level, last = i * tree.step, i == 0
        above = paths.select(F.col("g").alias("pg"), F.col("idx").alias("p_idx"), "path", "extra")
        subtrees = tree.levels[i].join(above, F.col("g").eqNullSafe(F.col("pg")) & (F.col("sub") == F.col("p_idx")))
        subtrees = _levels(subtrees, level, tree.step)
        at = [F.floor(F.col("at") / FANOUT**k).cast("int") for k in range(tree.step)]
        beside = []
        for k in range(tree.step):
            run, own = F.slice(F.col(f"lv{k}"), F.floor(at[k] / FANOUT).cast("int") * FANOUT + 1, FANOUT), at[k] % FANOUT
            sides = F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("left"), F.array_join(F.slice(run, own + 2, F.lit(FANOUT)), "").alias("right"))
            beside.append(F.when(_count(level + k) > 1, sides))
        kept = ["g", "n", "sub", "path", "extra", *(f"lv{k}" for k in range(tree.step))]
        nodes = subtrees.select(*kept, F.posexplode("nodes").alias("at", "node"))
        path = F.concat(F.filter(F.array(*beside), lambda x: x.isNotNull()), F.col("path"))
        found = [F.col("g"), F.col("node.idx").alias("idx"), path.alias("path"), F.col("extra")]
        paths = nodes.select(*found, *([F.col("node.digest").alias("digest"), F.col("node.row").alias("row")] if last else []))
    return paths


def proofs(manifest: Manifest, carry: list[str] | None = None) -> DataFrame:
    """id, leaf, subroot, path (for each level from the leaf's to the root's the siblings left and right of the node, as joined hex digests), and the carried columns."""
    tip = manifest.groups.tops.select("g", F.lit(0).cast("long").alias("idx"), F.expr(f"cast(array() as {PATH})").alias("path"), F.struct(F.lit(0)).alias("extra"))
    groups = _descend(manifest.groups, tip)
    starts = groups.select(F.col("row.id").alias("g"), F.lit(0).cast("long").alias("idx"), "path", F.struct(F.col("digest").alias("subroot")).alias("extra"))
    found = _descend(manifest.rows, starts)
    return found.select(F.col("row.id").alias("id"), F.col("digest").alias("leaf"), F.col("extra.subroot").alias("subroot"), "path", *(F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry or [])))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, p: digest_of(p["left"], node, p["right"]))


def manifest_check(docs: DataFrame) -> DataFrame:
    """The manifest of `documents`, every row's proof, and what it says of the rows whose text has been tampered with (lower-cased where 3 divides the crc32 of the id)."""
    changed = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    tampered = F.when(id_bucket("doc_id", 3) == 0, leaf(changed))
    rows = docs.select("doc_id", "lang", leaf([F.col(f) for f in FIELDS]).alias("leaf"), tampered.alias("tampered"))
    manifest = build(rows, "lang", "doc_id", "leaf", ["tampered"])
    root = F.lit(manifest.root).cast("string")
    out = proofs(manifest, ["tampered"]).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, lang, {LEAF_SQL.format(text="text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id")} % 3 = 0 THEN {LEAF_SQL.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
t AS (
  SELECT lang AS g, 0 AS lvl, idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT g, lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY g, lvl, idx // 8, n),
subroots AS (SELECT g, digest, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, idx, digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, idx // 8, n),
runs AS (
  SELECT 'rows' AS tree, g, lvl, idx // 8 AS run, list(digest ORDER BY idx) AS d FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 'groups', NULL, lvl, idx // 8, list(digest ORDER BY idx) FROM u WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT doc_id, lang, leaf, idx AS place, 'rows' AS tree, 0 AS lvl, idx, coalesce(tampered, leaf) AS acc, '' AS beside FROM placed
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.place, CASE WHEN r.d IS NULL THEN 'groups' ELSE w.tree END, CASE WHEN r.d IS NULL THEN 0 ELSE w.lvl + 1 END, CASE WHEN r.d IS NULL THEN s.idx ELSE w.idx // 8 END,
    CASE WHEN r.d IS NULL THEN w.acc ELSE sha256(array_to_string(r.d[1:w.idx % 8], '') || w.acc || array_to_string(r.d[w.idx % 8 + 2:], '')) END,
    CASE WHEN r.d IS NULL THEN w.beside ELSE w.beside || array_to_string(r.d[1:w.idx % 8], '') || array_to_string(r.d[w.idx % 8 + 2:], '') END
  FROM walk w JOIN subroots s ON s.g IS NOT DISTINCT FROM w.lang
  LEFT JOIN runs r ON r.tree = w.tree AND (w.tree = 'groups' OR r.g IS NOT DISTINCT FROM w.lang) AND r.lvl = w.lvl AND r.run = w.idx // 8
  WHERE r.d IS NOT NULL OR w.tree = 'rows'),
ends AS (SELECT *, row_number() OVER (PARTITION BY lang, place ORDER BY tree, lvl DESC) AS last FROM walk)
SELECT e.doc_id, e.leaf, s.digest AS subroot, r.digest AS root, sha256(e.beside) AS proof_sha256, e.acc AS folded_root, e.acc = r.digest AS verified
FROM ends e JOIN subroots s ON s.g IS NOT DISTINCT FROM e.lang, (SELECT digest FROM u WHERE n = 1) r WHERE e.last = 1
"""
