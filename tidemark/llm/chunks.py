"""Encoding of whole Arrow batches by their distinct chunks.

Natural text repeats its words. A batch of texts is cut into chunks at places where the tokenizer cuts anyway, the chunks are
dictionary-encoded by Arrow, each distinct chunk is encoded once (and remembered by the Python worker, up to its share of an executor's
bytes; frequent chunks come early, so what is known then stays), and the ids of the texts are gathered by numpy. The result equals encoding each whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a remembered chunk besides its text and its ids: two objects and their place in the dictionary.
EACH = 190
#: Characters that some library may take for white space.
WHITE = r"\s\x0b\x1c-\x1f\p{Z}\x{85}"


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """The rows again, in batches of about `most` bytes of text, whatever the number of rows that Spark sent at once."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(lengths[at:])
            n = max(1, int(np.searchsorted(ends, most - size, side="right")))
            n = min(n, batch.num_rows - at)
            held.append(batch.slice(at, n))
            size += int(ends[n - 1])
            at += n
            if size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class ChunkCodes:
    """Ids of chunks as little-endian unsigned 32-bit bytes. A subclass says how chunks are encoded that aren't known yet."""

    def __init__(self, most: int):
        self.most, self.held, self.known = most, 0, {}

    def encode(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def remember(self, chunks: list[str], codes: list[bytes]) -> None:
        """Keeps the codes as long as they fit into `most` bytes."""
        for c, x in zip(chunks, codes, strict=True):
            size = EACH + 2 * len(c) + len(x)
            if self.held + size > self.most:
                return
            self.known[c] = x
            self.held += size

    def codes(self, distinct: list[str]) -> list[bytes]:
        found = list(map(self.known.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        for i, code in zip(missing, self.encode([distinct[i] for i in missing]), strict=True):
            found[i] = code
        return found

    def gather(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """For texts as lists of chunks: all ids one after another, and the number of ids of each text."""
        pool, starts, sizes, index, bounds = self._look_up(lists)
        each = sizes[index]
        ends = np.cumsum(each)
        at = np.repeat((starts[index] - ends + each).astype(np.int32), each)
        at += np.arange(len(at), dtype=np.int32)
        return pool[at], np.diff(np.concatenate(([0], ends))[bounds])

    def count(self, lists: pa.ListArray) -> np.ndarray:
        """The number of ids of each text."""
        _, _, sizes, index, bounds = self._look_up(lists)
        return np.diff(np.concatenate(([0], np.cumsum(sizes[index])))[bounds])

    def _look_up(self, lists: pa.ListArray) -> tuple[np.ndarray, ...]:
        bounds = lists.offsets.to_numpy()
        flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        codes = self.codes(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        pool = np.frombuffer(b"".join(codes), "<u4")
        return pool, np.cumsum(sizes) - sizes, sizes, flat.indices.to_numpy(zero_copy_only=False), bounds - bounds[0]


def without_empty(lists: pa.ListArray) -> pa.ListArray:
    """The lists without their empty strings."""
    full = pc.greater(pc.binary_length(lists.values), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(full)))[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.values.filter(pa.array(full)))


def with_space(parts: pa.ListArray) -> pa.ListArray:
    """Texts split at spaces: the chunks with the space that stood before them; the first of each text had none."""
    first, last = parts.offsets[0].as_py(), parts.offsets[-1].as_py()
    offsets = parts.offsets.to_numpy() - first
    space = np.ones(last - first, bool)
    space[offsets[:-1][np.diff(offsets) > 0]] = False
    chunks = pc.binary_join_element_wise(pc.if_else(pa.array(space), " ", ""), parts.values.slice(first, last - first), "")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), chunks)


def cut_at_spaces(texts: pa.Array) -> pa.ListArray:
    """Texts without nulls as chunks cut before each space that no white space follows.

    There a byte-level pattern always starts a new piece: of a longer run of white space it takes all but the last character first. So a run stays in one chunk,
    behind what stands before it, and all else is cut, however long the text.
    """
    runs = pc.match_substring_regex(texts, f"[ ][{WHITE}]")
    if not pc.any(runs).as_py():
        return with_space(pc.split_pattern(texts, " "))
    marks = (chr(i) for i in range(0xE000, 0xF900))
    mark = next(m for m in marks if not pc.any(pc.match_substring(texts, m)).as_py())
    return pc.split_pattern(pc.replace_substring_regex(texts, f" ([^{WHITE}])", f"{mark} \\1"), mark)
