"""All registered queries of the library."""

from quire.plans import (  # noqa: F401  each registers its own
    citation_queries,
    corpus_graph_queries,
    corpus_queries,
    document_graph_queries,
    evidence_queries,
    fact_queries,
    integrity_queries,
    queries,
    relation_queries,
    resolution_queries,
    section_queries,
    store_queries,
    triple_queries,
)
from quire.plans.registry import QUERIES, SQL  # noqa: F401
