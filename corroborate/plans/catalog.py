"""Every query of the engine by name: (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from corroborate.plans import claim_queries, evidence_queries, model_queries, neural_queries, record_queries, source_queries, stream_queries, triple_queries

QUERIES = {**evidence_queries.QUERIES, **triple_queries.QUERIES, **claim_queries.QUERIES, **model_queries.QUERIES, **neural_queries.QUERIES, **record_queries.QUERIES, **source_queries.QUERIES, **stream_queries.QUERIES}
