"""Many terms in whole texts: one Aho-Corasick automaton, built once in each Python worker, run once over each text of an Arrow batch.

Cases: a null or empty text has no hits; empty terms are left out and repeated ones count once; texts and terms are compared as they are, or with A-Z lower-cased on both sides;
positions are code points from 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that an automaton takes; they travel with the function, so their number must be bounded.
MOST = 1_000_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HITS = pa.list_(pa.struct([("start", pa.int64()), ("term", pa.string())]))
_BUILT: dict[tuple[str, ...], object] = {}


def automaton(terms: tuple[str, ...]):
    if terms not in _BUILT:
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in terms:
            found.add_word(t, t)
        if terms:
            found.make_automaton()
        _BUILT.clear()  # the worker lives on; it keeps one
        _BUILT[terms] = found
    return _BUILT[terms]


def hits_of(text: str | None, terms: tuple[str, ...], any_case: bool, whole_words: bool, longest: bool) -> list[tuple[int, str]]:
    """(start, term) of the terms in a text in order of start, then length."""
    if not text or not terms:
        return []
    seen = text.translate(LOWER) if any_case else text
    found = [(end - len(t) + 1, t) for end, t in automaton(terms).iter(seen)]
    if whole_words:
        edge = lambda i: not (0 <= i < len(seen) and seen[i].isalnum())
        found = [(s, t) for s, t in found if edge(s - 1) and edge(s + len(t))]
    found.sort(key=lambda x: (x[0], len(x[1])))
    if not longest:
        return found
    best, kept, end = {}, [], 0
    for s, t in found:
        best[s] = t  # the last of a start is its longest
    for s, t in best.items():
        if s >= end:
            kept.append((s, t))
            end = s + len(t)
    return kept


def term_hits(text: Column, terms: list[str], any_case: bool = True, whole_words: bool = False, longest: bool = False) -> Column:
    """Array of (start, term), term as compared. `whole_words`: no letter or digit beside a hit; `longest`: of hits that overlap, the leftmost and of these the longest."""
    known = tuple(sorted({t.translate(LOWER) if any_case else t for t in terms} - {""}))
    if len(known) > MOST:
        raise ValueError(f"more than {MOST} terms")

    @F.arrow_udf("array<struct<start:bigint,term:string>>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": s, "term": t} for s, t in hits_of(x, known, any_case, whole_words, longest)] for x in texts.to_pylist()], HITS)

    return found(text)
