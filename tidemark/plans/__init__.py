"""All registered queries of the library; the training-data operators register their own."""

from tidemark.plans import books, files, ledger, market, measures, pairs, rules, scalars, sets, streams, technical, texts, trials, whole  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
