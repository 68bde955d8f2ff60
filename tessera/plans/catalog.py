"""All registered queries of the engine and their DuckDB twins."""

from tessera.plans import enrich, lineage, parsing, records, reports, search, streams, vectors, workflow  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
