"""Every query of the engine proper, by name."""

from . import behaviour, catalog, flow, monitoring, retrieval, understanding  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
