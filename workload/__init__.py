"""Stand-in views over the supplied tables and the registered queries.

Importing the package fills :data:`workload.registry.QUERIES` and ``ORACLE``.
"""

from workload import cohort, identity, jobs, loading, screening, sources  # noqa: F401
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
