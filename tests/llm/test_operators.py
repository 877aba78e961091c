"""The ten operators against libraries, brute force, round trips and held-out accuracy, with the awkward cases of each."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from tests.conftest import DATA
from tidemark.llm import bin_packing, exact_dedup, language_id, license_scan, rank_queue_bpe, simhash_trie, token_counts, token_planes, toxicity, vp_trees
from tidemark.llm.queries import QUERIES, vocabulary
from tidemark.llm.word_codes import WordCodes, word_codes

SF = f"{DATA}/sf0.001"
ODD = [
    None, "", " ", "\n\n", "a", "It's  the\tend.\n\n Of   it", "<|endoftext|> x <|endoftext|>", "a <|endoftext|>", "x<|STARTOFTEXT|>y <|startoftext|>", "Ünï çödé — “quotes”… 12 345,67",
    "é ́a İstanbul Kelvin", "tab\x1cfs \x1f\n us", "日本語 テキスト", "😀😀 ok", "nbsp  x  y", "a" * 5000, " ".join(["don't", "we've,", "U.S.A."] * 2000), "x" + " " * 300 + "y", "　", "a \u0085b", "the the the",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(4, "a", "y", 2), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(df):
    return df.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_token_counts_equal_the_library(request, which):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = Counter(map(tuple, token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"), batch_bytes=3000).collect()))
    want = Counter()
    for i, t in texts_of(docs):
        n = len(library.encode(t, add_special_tokens=False).ids)
        want[i, len(t.encode()), n, n > 512] += 1
    assert got == want
    assert token_counts.count_tokens(empty(docs), vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_rank_queue_equals_the_library(request, which):
    import base64

    import tiktoken

    docs = request.getfixturevalue(which)
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = rank_queue_bpe.encode_and_decode(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=True, batch_bytes=3000).collect()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out)
    want = Counter()
    for i, t in texts_of(docs):
        ids = library.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want
    assert all(len(r.ids) == r.n_tokens for r in out)


def test_rank_queue_when_a_merge_brings_up_a_smaller_rank():
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 299, b"bc": 400, b"aab": 298, b"abcab": 297}
    library = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    own = rank_queue_bpe.RankQueueBpe(ranks, r"\S+|\s+")
    texts = ["abcabab", "aababcab" * 50, "abab abc bcab aab", "cbacba", "", "abcabcabcabc aabaab"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_texts(texts)] == [library.encode_ordinary(x) for x in texts]


def test_rank_queue_on_long_pre_tokens():
    import base64

    import tiktoken

    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = rank_queue_bpe.RankQueueBpe(rank_queue_bpe.read_ranks(data), public_tokenizers.PATTERN)
    dice = random.Random(3)
    for alphabet in ("a", "ab", "etaoin", "=-", "0123456789", "éàü"):
        text = "".join(dice.choice(alphabet) for _ in range(4000))
        assert own.encode_text(text) == library.encode_ordinary(text)
    assert not own.queue


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    dice = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = dice.integers(0, 2**32, n, dtype=np.uint32)
        assert np.array_equal(token_planes.from_planes(token_planes.to_planes(ids, bits), n), ids)


@pytest.mark.parametrize("which", ["odd", "documents"])
@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, request, which, bits, monkeypatch):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    folder = token_planes.new_folder(spark)
    manifest = token_planes.write_ids(docs, vocabulary("word_bpe_49k.json"), 2, folder, bits=bits)
    got = token_planes.read_ids(spark, manifest, folder, keep=True).collect()
    rows = texts_of(docs)
    of = defaultdict(Counter)
    for i, t in rows:
        of[i][(*library.encode(t, add_special_tokens=False).ids, 2)] += 1
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        of[r.doc_id][tuple(r.ids)] -= 1
        start += r.n_tokens
    assert not any(n for c in of.values() for n in c.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    none = token_planes.new_folder(spark)
    assert token_planes.read_ids(spark, token_planes.write_ids(empty(docs), vocabulary("word_bpe_49k.json"), 2, none), none).count() == 0


def test_one_document_is_read_by_the_index(spark, documents):
    import pyarrow.fs as pafs

    folder = token_planes.new_folder(spark)
    manifest = token_planes.write_ids(documents, vocabulary("word_bpe_49k.json"), 2, folder).orderBy("part").collect()
    fs, top = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{top}/{manifest[0].file}") as f:
        reader = token_planes.Reader(f)
        every = list(reader.docs())
        for i in (0, 3, len(every) - 1):
            assert np.array_equal(reader.document(i), every[i][2])


def test_word_codes_forget_nothing_when_full():
    with open(vocabulary("word_bpe_49k.json"), "rb") as f:
        model = f.read()
    texts = pa.array([t for t in ODD if t] * 2)
    a = word_codes(model, 1 << 20).ids(texts)
    for most in (0, 600, 5000):
        codes = WordCodes(model, most)
        for _ in range(2):
            b = codes.ids(texts)
            assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and codes.held <= most


def by_hand_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]+", " ", t)].append(i)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, odd, documents, weak):
    from pyspark.sql import functions as F

    digest = (lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)) if weak else exact_dedup.content_hash
    for docs in (odd, documents):
        rows = texts_of(docs)
        want = Counter()
        for text, ids in by_hand_groups(rows).items():
            keep = min((i for i in ids if i is not None), default=None)
            for i in ids:
                want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter(map(tuple, exact_dedup.exact_groups(docs, digest=digest).collect())) == want
    assert exact_dedup.exact_groups(empty(odd)).count() == 0
    left = exact_dedup.drop_exact_copies(documents)
    assert left.columns == documents.columns and left.count() == len(by_hand_groups(texts_of(documents)))


def by_hand_components(fps, budget):
    parent = {x: x for x in fps}

    def up(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    every = sorted(fps)
    for i, a in enumerate(every):
        for b in every[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= budget:
                parent[up(a)] = up(b)
    return {x: up(x) for x in fps}


def slow_fingerprint(text):
    import xxhash

    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_duplicates_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    rows = texts_of(docs)
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    root = by_hand_components({f for _, f in prints}, 3)
    least = defaultdict(lambda: float("inf"))
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(least[root[f]], i)
    want = Counter((i, f"{f:016x}", None if least[root[f]] == float("inf") else least[root[f]]) for i, f in prints)
    assert Counter(map(tuple, simhash_trie.near_duplicates(docs).collect())) == want
    assert simhash_trie.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("slice_rows", [50_000, 7])
def test_trie_join_equals_brute_force(spark, slice_rows):
    dice = random.Random(5)
    fps = {dice.getrandbits(64) for _ in range(150)}
    for f in list(fps):  # chains, and a dense cluster that shares a block
        for _ in range(3):
            f ^= 1 << dice.randrange(64)
            f ^= 1 << dice.randrange(64)
            fps.add(f)
    fps |= {0xABCD << 48 | 1 << dice.randrange(48) | 1 << dice.randrange(48) for _ in range(200)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    for budget in (0, 1, 3):
        edges = simhash_trie.links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps), budget, slice_rows)
        found = {r.node: r.root for r in simhash_trie.components(edges).collect()}
        want = by_hand_components(set(signed), budget)
        groups = defaultdict(set), defaultdict(set)
        for f in signed:
            groups[0][want[f]].add(f)
            groups[1][found.get(f, f)].add(f)
        assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_packing(spark, odd, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for docs, capacity in ((documents, 4096), (documents, 300), (odd, 64)):
        got = bin_packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 1, capacity).collect()
        want = Counter()
        for i, t in texts_of(docs):
            ids = [*library.encode(t, add_special_tokens=False).ids, 1]
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter(tuple(r)[:5] for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for own in by.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        least = -(-sum(r.length for r in got) // capacity)
        assert len(by) <= least * 1.02 + 1
    assert bin_packing.pack_documents(empty(odd), vocabulary("word_bpe_49k.json"), 1).count() == 0


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 3, 3, 2]  # 24: two bins of 12 do
    bins = [[0, 2], [1, 3], [4, 5]]
    better = bin_packing.local_search(bins, lengths, 12)
    assert len(better) == 2 and sorted(i for b in better for i in b) == list(range(6))
    dice = random.Random(2)
    for _ in range(20):
        lengths = [dice.randint(20, 60) for _ in range(60)]
        start = bin_packing.best_fit(lengths, 100)
        end = bin_packing.local_search(start, lengths, 100)
        assert len(end) <= len(start) and sorted(i for b in end for i in b) == list(range(60))
        assert all(sum(lengths[i] for i in b) <= 100 for b in end)


@pytest.mark.parametrize("factor", [1.0, 1.3])
def test_vp_trees(spark, factor):
    dice = np.random.default_rng(4)
    x = dice.normal(size=(700, 8)).astype(np.float32)
    x[100:140] = x[7]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(700, None, 1), (800, [0.0] * 8, 1), (900, [float("nan")] * 8, 1), (1000, [1.0, None] * 4, 1), (1100, [1.0, 2.0], 1), (None, [1.0] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = vp_trees.nearest(table, "id % 100 = 0", factor=factor, shard_rows=150).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    d = np.sqrt(((x[::100].astype(float)[:, None] - x.astype(float)[None]) ** 2).sum(-1))
    hits = 0
    for k, own in enumerate(d):
        q = 100 * k
        want = sorted((s, i) for i, s in enumerate(own.tolist()) if i != q)[:10]
        if factor == 1:
            assert [i for i, _ in found[q]] == [i for _, i in want]
            assert np.allclose([s for _, s in found[q]], [s for s, _ in want], rtol=1e-12)
        hits += len({i for i, _ in found[q]} & {i for _, i in want})
    assert hits >= 0.9 * 10 * len(d) and set(found) == set(range(0, 700, 100))
    assert vp_trees.nearest(empty(table), "id % 100 = 0").count() == 0


def slow_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_license_scan(spark, odd, documents):
    more = ["CC by cc-by! General (public) license", "all rights reserved, All Rights all rights reserved", "cc", "cc by", "Permission is hereby kindly granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Permission is hereby granted"]
    extra = spark.createDataFrame([(100 + i, t, "x", 1) for i, t in enumerate(more)] + [(100, more[0], "x", 1)], odd.schema)
    for docs in (odd, extra, documents):
        got = license_scan.scan(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *slow_scan(t)) for i, t in texts_of(docs))
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in license_scan.scan(extra).collect()}
    assert by[104].labels == "mit" and by[104].score >= 0.8 and by[105].labels == ""
    assert license_scan.scan(empty(odd)).count() == 0


def test_language_on_held_out(spark, odd):
    rows = QUERIES["op7_language_id"](spark, f"{DATA}/sf0.1").where("held_out").join(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    from pyspark.sql import functions as F

    known = language_id.fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"), F.lit(True))
    assert set(known) == {"en", "de"}
    out = {r.doc_id: r.language for r in language_id.predict(odd, known).collect()}
    assert out[0].pred == out[1].pred == out[2].pred == "und" and out[0].rejected and out[12].pred != "und"
    nothing = language_id.fit(empty(odd).withColumn("lang", F.lit("x")), F.lit(True))
    assert nothing == {} and {r.language.pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(empty(odd), known).count() == 0


def test_toxicity_on_held_out(spark, odd):
    got = QUERIES["op1_toxicity"](spark, f"{DATA}/sf0.1").where("held_out").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").collect()
    toxic = [r for r in got if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in got if not r.toxic) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.toxicity for r in toxicity.score(odd, nothing).collect()} == {0.0}
    assert toxicity.score(empty(odd), nothing).count() == 0


def test_swapped_groups_score_alike(spark):
    dice = random.Random(8)
    filler = "alpha beta gamma delta epsilon zeta".split()
    rows = []
    for i in range(400):
        bad = i % 2
        words = [dice.choice(filler) for _ in range(8)] + (["muslim"] if bad and i % 4 == 1 else []) + (["christian"] if not bad and i % 4 == 0 else []) + (["vile"] if bad and i % 3 else [])
        rows.append((i, " ".join(words), bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    gap = {}
    for penalty in (0.0, toxicity.SWAP_PENALTY):
        model = toxicity.fit(docs, docs.select("doc_id", "toxic"), penalty=penalty)
        gap[penalty] = abs(model.score("alpha muslim beta") - model.score("alpha christian beta"))
        assert model.score("alpha vile beta") > 0.3
    assert gap[toxicity.SWAP_PENALTY] < 0.3 * gap[0.0]
