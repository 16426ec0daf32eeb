"""Every registered query of the library."""

from stratocloud.queries import analysis, clouds, grids, sequences, stores  # noqa: F401
from stratocloud.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
