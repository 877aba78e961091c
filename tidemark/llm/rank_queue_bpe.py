"""Byte-level BPE with a hierarchical-bitmap rank queue, and decoding.

Each pre-token starts as a linked list of bytes. Neighbouring pairs that may merge lie in one bucket per merge rank, as list positions; a
three-level bitmap (64 x 64 x 64 ranks) over the buckets gives the next rank by find-first-set, and its bucket is merged from the left. A position
whose pair has changed since is stale and is skipped; if a merge brings up a smaller rank, the rest of the bucket waits. Many pre-tokens share one
queue, as their merges don't touch, so that one look for the next rank serves all of them. The work is n log n in the length, whatever the merges.

Texts, long ones included, are cut before spaces that no white space follows first, where the pattern always starts a new pre-token; distinct chunks are encoded once
and remembered by the Python worker within its share of an executor's bytes (see `chunks`).

Cases: null or empty text has no ids; repeated rows are rows of their own; a null id stays null; an empty table gives an empty result; only the id
and the text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkCodes, by_bytes, cut_at_spaces
from tidemark.llm.common import named, worker_bytes

BATCH_BYTES = 4 << 20
#: Bytes that the Python workers of an executor may remember together: more than elsewhere, as encoding a chunk takes longer.
EXECUTOR_CACHE = 640 << 20
#: Bytes of pre-tokens that one queue merges together (about 150 bytes of lists each).
RUN_BYTES = 1 << 19
#: Marks that end many chunks.
MARKS = ",.!?;:|"
_CODERS: dict[tuple[bytes, str], RankQueueBpe] = {}


class RankQueue:
    """Positions by merge rank; `take` gives the smallest rank and all its positions from the left."""

    def __init__(self, ranks: int):
        if ranks > 64**3:
            raise ValueError("three levels hold 262,144 ranks")
        self.low, self.mid, self.top = [0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def take(self) -> tuple[int, list[int]]:
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) | ((word & -word).bit_length() - 1)
        word = self.low[a]
        rank = (a << 6) | ((word & -word).bit_length() - 1)
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions

    def __bool__(self) -> bool:
        return bool(self.top)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class RankQueueBpe(ChunkCodes):
    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = EXECUTOR_CACHE // 8):
        import regex

        super().__init__(most)
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.decimal = [b"%d" % i for i in range(len(self.bytes_of))]
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        self.double = np.full(1 << 16, -1)
        for piece, rank in ranks.items():
            if len(piece) == 2:
                self.double[piece[0] << 8 | piece[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that are no tokens themselves, merged in one queue: no pair reaches across two of them."""
        data = b"".join(pieces)
        n, sizes = len(data), np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw, first = np.frombuffer(data, np.uint8).astype(np.int64), np.cumsum(sizes) - sizes
        pairs = np.append(self.double[raw[:-1] << 8 | raw[1:]], -1)
        pairs[first[1:] - 1] = -1
        starts = np.arange(-1, n)
        starts[first] = starts[n] = -1
        before = starts.tolist()  # where the part before the one at i starts; -1 at the start of a pre-token
        ends = list(range(1, n + 1))  # where the part that starts at i ends
        pair = pairs.tolist()  # rank of the part at i with the next one
        code = self.single[raw].tolist()  # id of the part at i
        queue, get = self.queue, self.ranks.get
        buckets = queue.buckets
        order = np.argsort(pairs, kind="stable")
        ranks, at = np.unique(pairs[order], return_index=True)
        for rank, positions in zip(ranks.tolist(), np.split(order, at[1:]), strict=True):
            if rank >= 0:
                queue.open(rank, positions.tolist())
        while queue.top:
            rank, positions = queue.take()
            lower = False
            for at, i in enumerate(positions):
                if pair[i] != rank:
                    continue  # stale
                j = ends[i]
                ends[i] = end = ends[j]
                code[i], code[j], pair[j] = rank, -1, -1
                if before[end] >= 0:
                    before[end] = i
                    pair[i] = new = get(data[i : ends[end]], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            queue.open(new, [i])
                        lower |= new < rank
                else:
                    pair[i] = -1
                if (h := before[i]) >= 0:
                    pair[h] = new = get(data[h:end], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            queue.open(new, [h])
                        lower |= new < rank
                if lower and at + 1 < len(positions):
                    queue.open(rank, positions[at + 1 :])  # a smaller rank has come up
                    break
        codes = np.array(code)
        ids = codes[codes >= 0].astype("<u4").tobytes()
        ends = np.cumsum(np.add.reduceat(codes >= 0, first, dtype=np.int64)) * 4
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token; those that need merging meet in queues of at most about RUN_BYTES (or one pre-token)."""
        whole = list(map(self.ranks.get, pieces))
        out = [b"" if rank is None else rank.to_bytes(4, "little") for rank in whole]
        run, size = [], 0
        for i in [i for i, rank in enumerate(whole) if rank is None]:
            if run and size + len(pieces[i]) > RUN_BYTES:
                self._fill(out, pieces, run)
                run, size = [], 0
            run.append(i)
            size += len(pieces[i])
        if run:
            self._fill(out, pieces, run)
        return out

    def _fill(self, out: list[bytes], pieces: list[bytes], run: list[int]) -> None:
        for i, ids in zip(run, self.merge([pieces[i] for i in run]), strict=True):
            out[i] = ids

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes."""
        cut = list(map(self.pattern.findall, texts))
        codes = self.encode_pieces([p.encode("utf-8", "surrogatepass") for pieces in cut for p in pieces])
        ends = np.cumsum([len(pieces) for pieces in cut]).tolist()
        return [b"".join(codes[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def encode_text(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, chunks: list[str]) -> list[bytes]:
        """A chunk of letters (behind a space or none) and one mark is two pre-tokens, which are remembered apart."""
        cut = [(c[:-1], c[-1]) if len(c) > 1 and c[-1] in MARKS and c[c[0] == " " : -1].isalpha() else (c, "") for c in chunks]
        needed = {x for pair in cut for x in pair}
        made = {x: self.known[x] for x in needed & self.known.keys()}
        new = list(needed - made.keys())
        codes = self.encode_texts(new)
        self.remember(new, codes)
        made.update(zip(new, codes, strict=True))
        return [made[head] + made[mark] if mark else made[head] for head, mark in cut]

    def ids(self, texts: pa.Array) -> list[list[int]]:
        """The ids of each text (null: none)."""
        ids, sizes = self.gather(cut_at_spaces(pc.fill_null(texts, "")))
        ends = np.cumsum(sizes)
        return [ids[a:b].tolist() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def coder(ranks: bytes, pattern: str, most: int) -> RankQueueBpe:
    """One coder for each Python worker, ranks file and pattern; `most`: bytes that it may remember."""
    if (ranks, pattern) not in _CODERS:
        _CODERS[ranks, pattern] = RankQueueBpe(read_ranks(ranks), pattern, most)
    return _CODERS[ranks, pattern]


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row; with `keep`, ids (array<int>) and decoded (binary) too. `ranks`: path of the ranks file."""
    with open(ranks, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    most = worker_bytes(docs.sparkSession, EXECUTOR_CACHE)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep else "")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for some in by_bytes(batches, "text", batch_bytes):
            mine = mine or coder(sent.value, pattern, most)
            for batch in some.combine_chunks().to_batches():
                ids = mine.ids(batch.column("text"))
                decoded = [mine.decode(x) for x in ids]
                decimal = mine.decimal.__getitem__
                columns = [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(map(decimal, x))).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], [*names, "ids", "decoded"]
                yield pa.record_batch(columns, names=names)

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(of, schema)
