from specloom.plans import (  # noqa: F401  (importing registers the queries)
    q_retrieval,
    q_audit,
    q_corpus,
    q_feedback,
    q_graph,
    q_stream,
    q_tables,
    q_text,
)
from specloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
