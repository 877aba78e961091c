"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows are dealt into batches of about equal bytes, whatever number of rows Spark sends at once. Texts, long ones included, are
split at safe boundaries: around special strings, which the library takes out first, and before a space that no white space follows, where the byte-level
pattern always starts a new piece. So the counts of the parts add up to the count of the whole text, and only a run of white space itself can't be split.

Cases: null or empty text counts 0 tokens; repeated rows give repeated rows; an empty table gives an empty result; only the id
and the text are read, so other columns can have any name. Special strings that swallow white space around them, or stand for whole words only, are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkCodes, by_bytes, cut_at_spaces
from tidemark.llm.common import named, worker_bytes

BATCH_BYTES = 4 << 20
_COUNTERS: dict[bytes, ByteCounts] = {}


class ByteCounts(ChunkCodes):
    """Counts of a byte-level BPE of the `tokenizers` library. A chunk's code has as many ids as the library gives."""

    def __init__(self, model: bytes, most: int):
        from tokenizers import Tokenizer

        super().__init__(most)
        self.library = Tokenizer.from_str(model.decode())
        added = list(self.library.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("special strings that reach beyond themselves")
        self.special = [t.content for t in added]
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def encode(self, chunks: list[str]) -> list[bytes]:
        codes = [bytes(4 * len(e.ids)) for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]
        self.remember(chunks, codes)
        return codes

    def counts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        mixed = pc.equal(pc.binary_length(texts), -1)
        for special in self.special:
            mixed = pc.or_(mixed, pc.match_substring(texts, special))
        out = self.count(cut_at_spaces(pc.if_else(mixed, "", texts)))
        for i in np.flatnonzero(mixed.to_numpy(zero_copy_only=False)).tolist():
            parts = self.around.split(texts[i].as_py())
            between = self.count(cut_at_spaces(pa.array(parts[::2], pa.string())))
            out[i] = between.sum() + len(parts) // 2
        return out


def byte_counts(model: bytes, most: int) -> ByteCounts:
    """One counter for each Python worker and tokenizer file; `most`: bytes that it may remember."""
    if model not in _COUNTERS:
        _COUNTERS[model] = ByteCounts(model, most)
    return _COUNTERS[model]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. `tokenizer`: path of a byte-level .json file, read on the driver and sent as bytes."""
    with open(tokenizer, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    most = worker_bytes(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for some in by_bytes(batches, "text", batch_bytes):
            counter = counter or byte_counts(model.value, most)
            some = some.combine_chunks()
            for batch in some.to_batches():
                sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
                yield pa.record_batch([batch.column("doc_id"), sizes, pa.array(counter.counts(batch.column("text")), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
