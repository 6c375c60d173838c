"""The operators as queries over the given tables, with SQL for each that SQL can express."""

from . import health, listing, matching, pages, sources  # noqa: F401
from . import quality  # noqa: F401, I001  last, as it unites the checks of all
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
