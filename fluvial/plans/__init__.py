"""Named query plans and their SQL twins."""

from . import expression_queries, pipeline_queries, raster_queries, sequence_queries, source_queries, spatial_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
