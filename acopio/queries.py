"""All registered queries of the engine."""

from .operators import catalog, contracts, decisions, matching, neighbours, planning, reasoning, recommend, reports, robust, scenarios, similarity, sparse, stored, stream_queries, texts, validation, weekly  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
