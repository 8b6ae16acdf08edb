"""All runnable queries with their SQL twins."""

from . import q_catalog, q_files, q_geo, q_names, q_raster, q_stream, q_terrain, q_zones  # noqa: F401
from .base import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
