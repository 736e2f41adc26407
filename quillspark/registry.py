"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from .operators import analytics, answers, causal, curation, extract, graph, inference, monitor, neighbours, network, postings, questions, ranking, regression, retrieval, sentences, sets, similarity, tags, telemetry, text, walks  # noqa: F401  each adds its queries
from .plans.named import QUERIES, SQL
from .sources import corpus, files  # noqa: F401
from .streaming import live, ordered  # noqa: F401

FLAGSHIP = "retrieve_hybrid"


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
