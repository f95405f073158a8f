"""The query catalogue: importing a module registers its queries."""

from . import document_queries, layout_queries, lexical_queries, profile_queries, review_queries, score_queries, series_queries, session_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
