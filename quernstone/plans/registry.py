"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import repairs, similarity, structured, text, words
from ..operators import corpus, events, graphs, large_graphs, messages, neardup, records, rerank, retrieval, segments, sessions, stores, trace
from ..sources import archives, folders, logs, pages
from ..streaming import exact, folds

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (retrieval, segments, events, trace, stores, neardup, corpus, sessions, graphs, large_graphs, messages, records, similarity, words, structured, repairs, text, rerank, pages, archives, logs, folders, folds, exact)
QUERIES: dict[str, Query] = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP: Query = segments.search
