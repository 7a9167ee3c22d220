"""Named queries over the driver's tables, each with its DuckDB oracle."""

from . import marts, cleaning, tenancy, identity, quality, insights  # noqa: F401,I001  (registers queries; order matters)
from .registry import ORACLE_SQL, QUERIES, register

__all__ = ["QUERIES", "ORACLE_SQL", "register"]
