"""Ids of the lower-casing word tokenizer (`tokenizers` library) for Arrow batches of whole texts.

The tokenizer drops white space and never joins characters across it, so a text may be cut at ASCII white space. Chunks are
lower-cased in ASCII first, as the tokenizer's own normalizer does; texts that hold `<|`, where upper and lower case differ
because special strings are matched before normalizing, go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.chunks import ChunkCodes, without_empty

_ENCODERS: dict[bytes, WordCodes] = {}
#: Marks that end many chunks. The tokenizer never joins letters and such a mark.
MARKS = ",.!?;:|"


class WordCodes(ChunkCodes):
    def __init__(self, model: bytes, most: int):
        from tokenizers import Tokenizer

        super().__init__(most)
        self.library = Tokenizer.from_str(model.decode())
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Letters with a mark behind them are encoded, and remembered, as letters and as mark."""
        cut = [(c[:-1], c[-1]) if c[-1] in MARKS and c[:-1].isalpha() else (c, "") for c in chunks]
        needed = {x for pair in cut for x in pair} - {""}
        made = {x: self.known[x] for x in needed & self.known.keys()}
        new = list(needed - made.keys())
        codes = self._library_codes(new)
        self.remember(new, codes)
        made.update(zip(new, codes, strict=True))
        return [made[head] + made[mark] if mark else made.get(head, b"") for head, mark in cut]

    def _library_codes(self, words: list[str]) -> list[bytes]:
        """Words of letters are encoded joined by spaces, many at a time: each ends with the one token that ends a word."""
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        for at in range(0, len(plain), 2048):
            some = plain[at : at + 2048]
            joined = " ".join([words[i] for i in some])
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                for i, lo, hi in zip(some, [0, *ends], ends, strict=False):
                    out[i] = data[lo:hi]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) one after another, and the number of ids of each."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", texts)))
        ids, sizes = self.gather(without_empty(words))
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        if not len(whole):
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        encoded = self.library.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
        for i, e in zip(whole, encoded, strict=True):
            parts[i] = np.array(e.ids, "<u4")
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def word_codes(model: bytes, most: int) -> WordCodes:
    """One encoder for each Python worker and tokenizer file; `most`: bytes that it may remember."""
    if model not in _ENCODERS:
        _ENCODERS[model] = WordCodes(model, most)
    return _ENCODERS[model]
