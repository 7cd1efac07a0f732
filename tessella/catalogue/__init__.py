"""All queries of the core, by name, and the SQL that must give the same rows."""

from tessella.catalogue import aggregation, datasets, documents, joins, packed, predicates, rules, similarity, spans, streams, texts  # noqa: F401
from tessella.catalogue.registry import COVERS, QUERIES, SQL

__all__ = ["COVERS", "QUERIES", "SQL"]
