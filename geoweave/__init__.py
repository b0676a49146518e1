"""geoweave — PySpark operators for linked, geospatial and raster data.

Every public operator takes and returns Spark DataFrames (or Columns).
Sub-packages:

* ``functions``  Column helpers (PostgreSQL-compatible strings, RDF terms, geometry)
* ``operators``  DataFrame operators (relational, mapping, graph, catalogue, city,
                 raster, road network, time series, styling)
* ``sources``    readers / writers (delimited, GeoJSON, N-Quads, OSM XML, snapshots)
* ``streaming``  the stateless mapping run on a file stream
* ``plans``      registered queries over the driver tables + their DuckDB oracles
"""

__version__ = "0.1.0"
