"""Registered queries over the driver tables and their DuckDB oracles.

Importing this package fills ``geoweave.plans.registry.QUERIES``.
"""

from geoweave.plans import catalog, coverage, geo, kg, mappings, network, raster, relational, series, sources, stream, tiling  # noqa: F401
from geoweave.plans.registry import QUERIES  # noqa: F401
