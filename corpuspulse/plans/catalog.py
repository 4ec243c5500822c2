"""Import every query module so that the registry is complete."""

from corpuspulse.plans import registry
from corpuspulse.plans import voting_queries, report_queries, ingest_queries, text_queries, scoring_queries, cluster_queries, stream_queries  # noqa: F401
from corpuspulse.plans import embedding_queries, lemma_queries, projection_queries, target_queries  # noqa: F401

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
