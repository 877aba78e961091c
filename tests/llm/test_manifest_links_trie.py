"""Merkle manifest, embedding near-duplicates and the conversation trie against brute force, on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_cases import CLASHING
from tidemark.llm import hyperplane_dedup, merkle, prefix_trie
from tidemark.llm.common import numbered

# Numbering


def test_numbered_within_groups(spark):
    dice = random.Random(1)
    rows = [(dice.choice([None, "a", "b"]) if i % 3 else "hot", dice.choice([None, 1, 2, 3])) for i in range(500)]
    found, _ = numbered(spark.createDataFrame(rows, "g string, number long"), "g", ["number"], "numbers")
    assert found.columns == ["g", "number", "number", "size"]
    got = defaultdict(list)
    for g, key, at, size in (tuple(r) for r in found.collect()):
        got[g].append((at, key, size))
    assert {g: len(x) for g, x in got.items()} == Counter(g for g, _ in rows)
    for some in got.values():
        some.sort()
        assert [at for at, _, _ in some] == list(range(len(some))) and {n for _, _, n in some} == {len(some)}
        keys = [(k is not None, k or 0) for _, k, _ in some]
        assert keys == sorted(keys)


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def by_hand_leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def grown(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return out


def by_hand_manifest(rows):
    trees, langs = {}, sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        own = sorted(((r.doc_id is not None, r.doc_id or 0, by_hand_leaf(r, r.text), r) for r in rows if r.lang == lang), key=lambda x: x[:3])
        trees[lang] = grown([x[2] for x in own]), [x[3] for x in own]
    top = grown([trees[x][0][-1][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        levels, own = trees[lang]
        for i, r in enumerate(own):
            path = way(levels, i) + way(top, at)
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            node = by_hand_leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)) if hit else levels[0][i]
            for left, right in path:
                node = h(left, node, right)
            out.append((r.doc_id, levels[0][i], levels[-1][0], top[-1][0], h(*(a + b for a, b in path)), node, node == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("n_langs", [1, 2, 11])
def test_manifest_equals_brute_force(spark, n_langs):
    dice = random.Random(n_langs)
    langs = [None, *(f"l{i}" for i in range(n_langs - 1))]
    rows = [(i, dice.choice(["Ab", "", None, "É" * 3, "X" * 20_000, "lower"]), langs[dice.randrange(n_langs) if i % 3 else 0], dice.choice([None, "s"]), dice.choice([None, 7])) for i in range(300)]
    rows += [(None, "Null", "l0", None, None)] * 2 + [rows[5]] * 3 + [(5, "Other", rows[5][2], "s", 1), (900, "Alone", "zz", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(1).alias(c) for c in CLASHING))
    got = merkle.manifest_check(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == by_hand_manifest(docs.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert merkle.manifest_check(docs.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 513])
def test_roots_do_not_depend_on_the_stored_levels(spark, step, n):
    rows = spark.range(n).select("id", F.lit("g").alias("g"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("d"))
    manifest = merkle.build(rows, "g", "id", "d", step=step)
    levels = grown([h(str(i)) for i in range(n)])
    assert manifest.root == levels[-1][0] and len(manifest.rows.levels) == max(1, -(-(len(levels) - 1) // step))
    if n in (9, 65):
        for r in merkle.proofs(manifest).collect():
            assert [(p.left, p.right) for p in r.path] == way(levels, r.id) and r.leaf == levels[0][r.id]
    manifest.discard(spark)


def test_leaves_tell_fields_apart(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "-"), ("-", None), ("", "-")], "x string, y string")
    assert rows.select(merkle.leaf([F.col("x"), F.col("y")])).distinct().count() == 5


# Embedding near-duplicates


def by_hand_links(rows, least):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    linked = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, p), (_, b, q) = rows[i], rows[j]
            if p is not None and p == q and ok(a) and ok(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    linked[i].add(j)
                    linked[j].add(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            at = todo.pop()
            if at not in group:
                group.add(at)
                todo += linked[at]
        seen |= group
        least_id = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        for k in group:
            out[k] = (rows[k][0], len(linked[k]), least_id, rows[k][0] == least_id)
    return Counter(out)


def vectors(seed=3):
    dice = np.random.default_rng(seed)
    centres = dice.standard_normal((12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + dice.standard_normal(16) * dice.choice([0.05, 0.2, 0.4])], i % 3) for i in range(220)]
    rows += [(i, rows[7][1], 1) for i in range(300, 340)] + [(400, [2 * x for x in rows[7][1]], 1), (401, [-x for x in rows[7][1]], 1), (402, rows[7][1], 2)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan"), *[1.0] * 15], 1), (503, [None, *[1.0] * 15], 1), (504, [float("inf"), *[1.0] * 15], 1), (505, rows[7][1], None), (506, [], 1)]
    rows += [(600, [1.0, 2.0], 1), (601, [1.0, 2.1], 1), (7, rows[20][1], 1), (7, rows[7][1], 1), (None, rows[7][1], 1), (None, [9.0, -1.0], 0), (602, [-0.0, 1.0], 0), (603, [0.0, 1.0], 0)]
    return rows + [(700, [1e-30] * 16, 1), (701, [1e30] * 16, 1)]


@pytest.mark.parametrize("slice_rows, kind", [(hyperplane_dedup.SLICE, "float"), (3, "float"), (20, "double")])
def test_links_equal_brute_force(spark, slice_rows, kind):
    rows = vectors()
    if kind == "double":
        rows += [(800, [1e-200] * 16, 1), (801, [1e200] * 16, 1)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").select("*", *(F.lit(1).alias(c) for c in CLASHING if c != "label"))
    got = hyperplane_dedup.near_duplicates(df, miss=1e-9, slice_rows=slice_rows)
    assert Counter(map(tuple, got.collect())) == by_hand_links([(r.vec_id, r.embedding, r.label) for r in df.collect()], hyperplane_dedup.LEAST)
    assert hyperplane_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_dense_cluster_counts_each_pair_once():
    dice = np.random.default_rng(5)
    x = dice.standard_normal(8) + 0.02 * dice.standard_normal((1500, 8))
    x = np.r_[x, dice.standard_normal((300, 8))]
    sig = hyperplane_dedup.signs(x, 8, 6)
    total = np.zeros(len(x), np.int64)
    for t in range(6):
        for value in np.unique(sig[:, t]):
            at = np.flatnonzero(sig[:, t] == value)
            at = at[np.lexsort(sig[at, :t].T[::-1])] if t else at
            if len(at) > 1:
                total[at] += hyperplane_dedup.bucket_links(x[at], sig[at], np.ones(len(at), np.int64), t, 0, 0.93)[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (sig[:, None] == sig[None]).any(2)
    assert (total == near.sum(1) - 1).all()


def test_plan_meets_its_chance():
    for largest in (0, 1, 5_000, 10**6, 10**9):
        bits, tables = hyperplane_dedup.plan(largest)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= 1e-4


# Conversation trie


def by_hand_trie(rebuilt):
    members, ends, last, parent, depth, ids = defaultdict(list), defaultdict(list), {}, {0: None}, {0: 0}, {}
    for c in sorted(rebuilt):
        n = 0
        members[n].append(c)
        for t in rebuilt[c]:
            m = ids.setdefault((n, t), len(ids) + 1)
            parent[m], depth[m], last[m] = n, depth[n] + 1, len(t[1])
            members[m].append(c)
            n = m
        ends[n].append(c)
    kids = Counter(p for p in parent.values() if p is not None)
    leaves, saved = Counter(), Counter()
    for n in sorted(parent, key=lambda n: -depth[n]):
        leaves[n] += not kids[n]
        saved[n] += (len(members[n]) - 1) * last.get(n, 0)
        if parent[n] is not None:
            leaves[parent[n]] += leaves[n]
            saved[parent[n]] += saved[n]
    return Counter(
        (members[n][0], depth[n], None if n == 0 else members[parent[n]][0], len(members[n]), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in parent if members[n]
    )


def by_hand_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    seq = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    return {c: seq.get(c - c % 100 if c >= 0 else c + -c % 100, [])[: (k := zlib.crc32(str(c).encode()) % 6)] + s[k:] for c, s in seq.items()}


@pytest.mark.parametrize("shard, block", [(prefix_trie.SHARD, prefix_trie.BLOCK), (7, 2), (64, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    dice = random.Random(2)
    rows = []
    for c in [*range(0, 230), *range(-130, -60), 1000, 1001, 2105, 2106]:
        n = dice.choice([1, 1, 2, 3, 6, 9])
        for turn in range(n):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", dice.choice(["a", "b", "é"]) * (turn + 1)))
    rows += [(c, t, "user", f"same {t}") for c in range(3000, 3040) for t in range(20)]
    rows += [(4000, t, None, None) for t in range(3)] + [(4001, None, "user", ""), (4001, None, "user", "x"), (4001, 1, None, "y"), (4001, 1, None, "y"), (None, 0, "user", "no id"), (4002, 5, "u", "ser"), (4003, 5, "us", "er"), (4100, 0, "user", "L" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in CLASHING))
    got = prefix_trie.rebuilt_trie(df)
    assert Counter(map(tuple, got.collect())) == by_hand_trie(by_hand_rebuilt(rows))


def test_trie_of_no_conversations(spark):
    df = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.rebuilt_trie(df).count() == 0 and prefix_trie.rebuilt_trie(df.limit(0)).count() == 0


# SimHash: the walk's front is bounded


def test_a_crowded_trie_join_stays_small():
    """200,000 fingerprints on four values of one block, in a process of its own, below 400 MB."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from tidemark.llm.simhash_trie import trie_links
d = np.random.default_rng(3)
keys = np.concatenate([np.sort((np.uint64(g) << np.uint64(48)) | d.integers(0, 1 << 48, 50_000, dtype=np.uint64)) for g in range(4)])
trie_links(keys, [(g * 50_000, (g + 1) * 50_000) * 2 for g in range(4)], 16, 3)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert int(out.stdout.split()[-1]) < 400, out


def test_a_bounded_front_finds_every_link(monkeypatch):
    from tidemark.llm import simhash_trie

    monkeypatch.setattr(simhash_trie, "FRONT", 40)
    monkeypatch.setattr(simhash_trie, "LEAF_PAIRS", 100)
    dice = np.random.default_rng(4)
    keys = np.unique(np.concatenate([dice.integers(0, 1 << 48, 300, dtype=np.uint64), np.uint64(12345) ^ (np.uint64(1) << dice.integers(0, 20, 100).astype(np.uint64))]))
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= 3
    want = np.arange(len(keys))
    while not np.array_equal(want, new := np.array([want[row].min() for row in near])):
        want = new
    got = simhash_trie.trie_links(keys, [(0, len(keys), 0, len(keys))], 16, 3)
    while not np.array_equal(got, got[got]):
        got = got[got]
    assert np.array_equal(got, want)
