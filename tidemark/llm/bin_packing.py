"""Best-fit packing of token sequences, improved by swap-based local search.

Documents longer than a sequence are cut into full pieces and a rest. The pieces (without their ids) are dealt into shards by a hash of their place, so that repeated rows part too, about
`SHARD_TOKENS` tokens each; a task packs a shard by best fit, longest first, then searches locally: between underfull bins it moves a document, exchanges one for one, or two
for one, whenever that increases the sum of squared fills, until none does or the lower bound is met. Then the emptiest bin of each shard is packed anew with those of others, in the same way
(`LEFT` bins in a group), so that shards don't cost a partly filled sequence each.

Cases: null or empty text has only the end id; repeated rows are packed each; a null id stays null; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import by_bytes
from tidemark.llm.common import EXECUTOR_CACHE, named, shards, staged, worker_bytes
from tidemark.llm.word_codes import word_codes

CAPACITY, SHARD_TOKENS, BATCH_BYTES = 4096, 1_000_000, 4 << 20
#: Shards whose emptiest bins meet in one group.
LEFT = 512


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions, longest first, each into the fullest bin that has room."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for i in order:
        size = lengths[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room.setdefault(room - size, []).append(b)
        rooms |= 1 << (room - size)
    return bins


def _few(own: list[int], lengths: list[int]) -> list[int]:
    """At most two documents of each length: more can't take part in one exchange."""
    of: dict[int, list[int]] = {}
    for i in own:
        of.setdefault(lengths[i], []).append(i)
    return [i for same in of.values() for i in same[:2]]


def _exchange(source: list[int], target: list[int], room: int, gap: int, lengths: list[int]) -> tuple[list[int], list[int]] | None:
    """What to move from source to target and back, so that the target grows by 1 to `room` tokens; the largest growth found.

    A growth of g changes the sum of squares by 2g(g + gap), where gap is the target's fill less the source's; it must be positive.
    """
    source, target = _few(source, lengths), _few(target, lengths)
    best, found = max(0, -gap), None
    for i in source:
        if best < lengths[i] <= room:
            best, found = lengths[i], ([i], [])
    back = sorted((lengths[j], j) for j in target)
    sizes = [s for s, _ in back]

    def one_back(out: list[int]) -> None:
        nonlocal best, found
        total = sum(lengths[i] for i in out)
        k = bisect_left(sizes, total - room)
        if k < len(back) and best < total - sizes[k] <= room:
            best, found = total - sizes[k], (out, [back[k][1]])

    for a, i in enumerate(source):
        one_back([i])
        for j in source[:a]:
            one_back([i, j])
    own = sorted((lengths[i], i) for i in source)
    own_sizes = [s for s, _ in own]
    for a, (x, i) in enumerate(back):
        for y, j in back[:a]:
            k = bisect_right(own_sizes, x + y + room) - 1
            if k >= 0 and best < own_sizes[k] - x - y <= room:
                best, found = own_sizes[k] - x - y, ([own[k][1]], [i, j])
    return found


def _sums(own: list[int], lengths: list[int]) -> tuple[int, int]:
    """The lengths in a bin, and the sums of two of them, as bits."""
    count: dict[int, int] = {}
    for i in own:
        count[lengths[i]] = count.get(lengths[i], 0) + 1
    one = two = 0
    for x, n in count.items():
        two |= one << x | (1 << 2 * x if n > 1 else 0)
        one |= 1 << x
    return one, two


def _raised(sums: int, low: int, high: int) -> int:
    """The bits of `sums`, each moved up by every distance from `low` to `high`."""
    out, width = sums << low, 1
    while width < high - low + 1:
        step = min(width, high - low + 1 - width)
        out |= out << step
        width += step
    return out


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties bins until no move or exchange between any two increases the sum of squared fills, or no fewer bins are possible.

    Whether a source can make a target grow is told by bits: what may come back (nothing, one or two documents), raised by each growth allowed, against what may go.
    A pair that had no exchange is tried again only when one of the two has changed. Each step increases an integer that is bounded, so the search ends.
    """
    bins = list(bins)
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    live = sum(1 for b in bins if b)
    sums = [_sums(b, lengths) for b in bins]
    # For targets not emptier than the source: what one document may be exchanged for, and what two may.
    grown = [(0, 0)] * len(bins)
    changed, tried, step = [0] * len(bins), [-1] * len(bins), 0

    def note(b: int) -> None:
        one, two = sums[b] = _sums(bins[b], lengths)
        room = capacity - fill[b]
        grown[b] = (_raised(1 | one | two, 1, room), _raised(one, 1, room)) if room and bins[b] else (0, 0)
        changed[b] = step

    def possible(s: int, t: int) -> bool:
        one, two = sums[s]
        a, b = grown[t]
        if not (one & a or two & b):
            return False
        gap = fill[t] - fill[s]
        if gap >= 0:
            return True
        own, pairs = sums[t]
        low, high = 1 - gap, capacity - fill[t]
        return low <= high and bool(one & _raised(1 | own | pairs, low, high) or two & _raised(own, low, high))

    if live > least:
        for b in range(len(bins)):
            note(b)
    improved = True
    while improved and live > least:
        improved = False
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b))
        for source in under:
            again = True
            while again and bins[source] and fill[source] < capacity and live > least:
                again = False
                for target in reversed(under):
                    if target == source or not bins[target] or fill[target] >= capacity or max(changed[source], changed[target]) <= tried[source]:
                        continue
                    while bins[source] and possible(source, target):
                        found = _exchange(bins[source], bins[target], capacity - fill[target], fill[target] - fill[source], lengths)
                        out, back = found
                        step += 1
                        bins[source] = [i for i in bins[source] if i not in out] + back
                        bins[target] = [i for i in bins[target] if i not in back] + out
                        moved = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                        fill[source], fill[target] = fill[source] - moved, fill[target] + moved
                        note(source)
                        note(target)
                        improved = again = True
                    if not bins[source]:
                        live -= 1
                        break
                if not again:
                    tried[source] = step
            if live <= least:
                break
    return [b for b in bins if b]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, cache: int = EXECUTOR_CACHE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; with `keep`, ids (array<int>) too. `cache`: bytes that the workers of an executor may remember together."""
    with open(tokenizer, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep else [])]
    schema = pa.schema(fields)
    most = worker_bytes(docs.sparkSession, cache)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_bytes(batches, "text", BATCH_BYTES):
            codes = word_codes(model.value, most)
            for batch in some.combine_chunks().to_batches():
                ids, sizes = codes.ids(batch.column("text"))
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
                rows, at = [], 0
                for doc_id, n in zip(batch.column("doc_id").to_pylist(), (sizes + 1).tolist(), strict=True):
                    for k, start in enumerate(range(0, n, capacity)):
                        own = ids[at + start : at + min(n, start + capacity)]
                        rows.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if keep else [])))
                    at += n
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        pa.default_memory_pool().release_unused()  # the worker lives on

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep else ""))


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """`cut` (written: it is read twice; with a column length, 1 to `capacity`) with sequence_id and offset."""
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    n = shards(total, shard_tokens)
    # The number of a row within its file keeps equal rows apart, and is the same when a task runs again.
    dealt = cut.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, piece, ids_crc32, monotonically_increasing_id()), {n}) as long)"))
    if n == 1:
        return _packed(dealt, capacity).drop("shard", "left")
    filled = staged(_packed(dealt, capacity), "packed")
    left = filled.where("left").drop("sequence_id", "offset", "left").withColumn("shard", F.expr(f"{n} + cast(shard div {LEFT} as long)"))
    return filled.where("not left").drop("shard", "left").unionByName(_packed(left, capacity).drop("shard", "left"))


def _packed(dealt: DataFrame, capacity: int) -> DataFrame:
    """Packs each `shard`; `left` marks the pieces of its emptiest bin."""

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        for b, own in enumerate(bins):
            at = 0
            for i in own:
                sequence[i], offset[i] = b, at
                at += lengths[i]
        left = sequence == min(range(len(bins)), key=lambda b: sum(lengths[i] for i in bins[b]))
        sequence += t.column("shard")[0].as_py() << 24  # a shard has far fewer bins
        return t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("left", pa.array(left))

    kinds = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    return dealt.groupBy("shard").applyInArrow(fill, f"{kinds}, sequence_id long, offset long, left boolean")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cache: int = EXECUTOR_CACHE) -> DataFrame:
    return pack(staged(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, cache=cache), "pieces"), capacity)
