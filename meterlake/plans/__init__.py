"""Query plans by name."""

from . import analysis, ingest, reports, resolve, streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
