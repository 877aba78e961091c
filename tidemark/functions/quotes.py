"""Where a quote stands in a whole text, although some characters were changed, dropped or added.

Seed and extend: cut into one piece more than the edits allowed, a quote keeps at least one piece whole, so the places of its pieces, widened by the edits, are all that must be looked at. Windows that touch
are merged, and each is read once by bit-parallel matching with the quote as one long word of bits. So a text costs its length at most, however common the pieces are.

The span found has the fewest edits; of those the first to start, and of those the shortest. Cases: a null text or quote, an empty quote, and a quote that needs more edits give null;
quotes of no more characters than edits would match anything and give null too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _distances(text: str, masks: dict[str, int], m: int, anchored: bool) -> Iterator[int]:
    """After each character of `text` the least distance of the quote to what ends there; `anchored`: to all of the text so far."""
    every, high = (1 << m) - 1, 1 << (m - 1)
    more, less, score = every, 0, m
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | less
        horizontal = (((eq & more) + more) ^ more) | eq
        up, down = less | (every & ~(horizontal | more)), more & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1 | anchored) & every, (down << 1) & every
        more, less = down | (every & ~(vertical | up)), up & vertical
        yield score


def _masks(quote: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(quote):
        found[c] = found.get(c, 0) | 1 << i
    return found


def _windows(text: str, quote: str, edits: int) -> list[tuple[int, int]]:
    m, n = len(quote), edits + 1
    cuts = [m * i // n for i in range(n + 1)]
    found = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        piece, at = quote[lo:hi], text.find(quote[lo:hi])
        while at >= 0:
            found.append((max(0, at - lo - edits), min(len(text), at + m - lo + edits)))
            at = text.find(piece, at + 1)
    found.sort()
    merged: list[list[int]] = []
    for lo, hi in found:
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(lo, hi) for lo, hi in merged]


def span_of(text: str | None, quote: str | None, edits: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of a quote in a text."""
    if not text or not quote or len(quote) <= edits:
        return None
    if (at := text.find(quote)) >= 0:
        return at, at + len(quote), 0
    m, masks, best, ends = len(quote), _masks(quote), edits + 1, []
    for lo, hi in _windows(text, quote, edits):
        for i, d in enumerate(_distances(text[lo:hi], masks, m, False)):
            if d < best:
                best, ends = d, []
            if d == best <= edits:
                ends.append(lo + i + 1)
    found, back = [], _masks(quote[::-1])
    for end in ends:
        before = text[max(0, end - m - edits) : end][::-1]
        lengths = [n for n, d in enumerate(_distances(before, back, m, True), 1) if d == best]
        found.append((end - max(lengths), end, best))
    return min(found, default=None)


def quote_span(text: Column, quote: Column, edits: int) -> Column:
    """Struct of start (code points from 0), end and edits of a quote in a text, null where there is none. Python in Arrow batches: approximate matching has no native form."""
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])

    @F.arrow_udf("struct<start:bigint,end:bigint,edits:bigint>")
    def found(texts: pa.Array, quotes: pa.Array) -> pa.Array:
        spans = [span_of(t.as_py(), q.as_py(), edits) for t, q in zip(texts, quotes, strict=True)]
        return pa.array([s and dict(zip(("start", "end", "edits"), s, strict=True)) for s in spans], kind)

    return found(text, quote)
