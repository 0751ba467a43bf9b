"""Every registered query with its DuckDB equivalent."""

from __future__ import annotations

from palisade.plans import alignment_queries, chain_queries, cluster_queries, extra_queries, gene_queries, sequence_queries

QUERIES: dict = {**alignment_queries.QUERIES, **sequence_queries.QUERIES, **chain_queries.QUERIES, **extra_queries.QUERIES, **cluster_queries.QUERIES, **gene_queries.QUERIES}
ORACLE: dict = {**alignment_queries.ORACLE, **sequence_queries.ORACLE, **chain_queries.ORACLE, **extra_queries.ORACLE, **cluster_queries.ORACLE, **gene_queries.ORACLE}
