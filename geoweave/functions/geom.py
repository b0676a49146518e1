"""Geometry as a nested struct, with Column functions built from higher-order built-ins.

``geom = STRUCT<type STRING, srid INT, parts ARRAY<ARRAY<ARRAY<STRUCT<x,y,z DOUBLE>>>>>``:
part → ring → vertex.  A Point is ``[[[p]]]``, a LineString ``[[pts]]``, a Polygon
``[[shell, hole…]]``, Multi* have several parts; a POLYHEDRALSURFACE (extruded
solid) has one single-ring part per face.  Everything below is a Catalyst
expression (``transform`` / ``aggregate`` / ``flatten``): JVM-side, no Python in
the loop (higher-order functions are interpreted rather than code-generated).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions.util import as_col

VERTEX = "struct<x:double,y:double,z:double>"
GEOM = f"struct<type:string,srid:int,parts:array<array<array<{VERTEX}>>>>"


def vertex(x, y, z=None) -> Column:
    zc = F.lit(None).cast("double") if z is None else as_col(z).cast("double") if not isinstance(z, (int, float)) else F.lit(float(z))
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"), zc.alias("z"))


def make_geom(gtype: str | Column, parts: Column, srid: int | Column | None = None) -> Column:
    t = F.lit(gtype) if isinstance(gtype, str) else gtype
    s = F.lit(srid).cast("int") if not isinstance(srid, Column) else srid.cast("int")
    return F.struct(t.alias("type"), s.alias("srid"), parts.alias("parts"))


def point(x, y, z=None, srid=None) -> Column:
    return make_geom("POINT", F.array(F.array(F.array(vertex(x, y, z)))), srid)


def box(xmin, ymin, xmax, ymax, z=None, srid=None) -> Column:
    """Axis-aligned rectangle as a counter-clockwise closed POLYGON."""
    ring = F.array(vertex(xmin, ymin, z), vertex(xmax, ymin, z), vertex(xmax, ymax, z), vertex(xmin, ymax, z),
                   vertex(xmin, ymin, z))
    return make_geom("POLYGON", F.array(F.array(ring)), srid)


def _map_vertices(geom, fn) -> Column:
    g = as_col(geom)
    parts = F.transform(g["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, fn)))
    return g.withField("parts", parts)


def vertices(geom) -> Column:
    """All vertices as one array."""
    return F.flatten(F.flatten(as_col(geom)["parts"]))


# --- measures ----------------------------------------------------------------------------

def ring_signed_area(ring: Column) -> Column:
    """Shoelace sum / 2 (positive for counter-clockwise rings)."""
    n = F.size(ring)
    s = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), F.lit(0.0),
                    lambda acc, i: acc + ring[i]["x"] * ring[i + 1]["y"] - ring[i + 1]["x"] * ring[i]["y"])
    return F.when(n >= 4, s / 2.0).otherwise(F.lit(0.0))


def st_area(geom) -> Column:
    """G1: planar area — per polygon part |shell| − Σ|holes| (2D, like ``ST_Area``)."""
    g = as_col(geom)
    part_area = lambda part: F.aggregate(
        F.transform(part, lambda ring, i: F.abs(ring_signed_area(ring)) * F.when(i == 0, 1.0).otherwise(-1.0)),
        F.lit(0.0), lambda a, b: a + b)
    per_part = F.transform(g["parts"], part_area)
    is_areal = g["type"].isin("POLYGON", "MULTIPOLYGON", "POLYHEDRALSURFACE", "TIN")
    return F.when(is_areal, F.aggregate(per_part, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))


def st_zmin(geom) -> Column:
    """G2."""
    return F.array_min(F.transform(vertices(geom), lambda p: p["z"]))


def st_zmax(geom) -> Column:
    return F.array_max(F.transform(vertices(geom), lambda p: p["z"]))


def st_xmin(geom) -> Column:
    return F.array_min(F.transform(vertices(geom), lambda p: p["x"]))


def st_xmax(geom) -> Column:
    return F.array_max(F.transform(vertices(geom), lambda p: p["x"]))


def st_ymin(geom) -> Column:
    return F.array_min(F.transform(vertices(geom), lambda p: p["y"]))


def st_ymax(geom) -> Column:
    return F.array_max(F.transform(vertices(geom), lambda p: p["y"]))


def st_envelope(geom) -> Column:
    """Bounding-box POLYGON; in 3D its southern corners carry the lowest and its northern ones the highest z."""
    g = as_col(geom)
    x0, y0, x1, y1, z0, z1 = st_xmin(g), st_ymin(g), st_xmax(g), st_ymax(g), st_zmin(g), st_zmax(g)
    ring = F.array(vertex(x0, y0, z0), vertex(x1, y0, z0), vertex(x1, y1, z1), vertex(x0, y1, z1), vertex(x0, y0, z0))
    return make_geom("POLYGON", F.array(F.array(ring)), g["srid"])


def st_npoints(geom) -> Column:
    return F.size(vertices(geom))


# --- coordinate edits --------------------------------------------------------------------

def st_force2d(geom) -> Column:
    """G3."""
    return _map_vertices(geom, lambda p: p.withField("z", F.lit(None).cast("double")))


def st_force3d(geom, z: float | Column = 0.0) -> Column:
    zc = z if isinstance(z, Column) else F.lit(float(z))
    return _map_vertices(geom, lambda p: p.withField("z", F.coalesce(p["z"], zc)))


def st_flip_coordinates(geom) -> Column:
    """Swap x and y."""
    return _map_vertices(geom, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y"), p["z"].alias("z")))


def st_translate(geom, dx=0.0, dy=0.0, dz=0.0) -> Column:
    """G5 (``dz`` on a 2D vertex leaves z NULL, as PostGIS does)."""
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return _map_vertices(geom, lambda p: F.struct((p["x"] + c(dx)).alias("x"), (p["y"] + c(dy)).alias("y"),
                                                  (p["z"] + c(dz)).alias("z")))


def st_reverse(geom) -> Column:
    """Reverse every ring."""
    g = as_col(geom)
    return g.withField("parts", F.transform(g["parts"], lambda part: F.transform(part, lambda ring: F.reverse(ring))))


def st_extrude(geom, h) -> Column:
    """POLYGON → closed POLYHEDRALSURFACE: floor (reversed), roof (+h) and one wall per edge of every ring."""
    g = as_col(geom)
    hc = h if isinstance(h, Column) else F.lit(float(h))
    part = g["parts"][0]
    base = F.transform(part, lambda ring: F.transform(ring, lambda p: p.withField("z", F.coalesce(p["z"], F.lit(0.0)))))
    up = lambda p: p.withField("z", p["z"] + hc)
    floor = F.array(F.transform(base, lambda ring: F.reverse(ring)))
    roof = F.array(F.transform(base, lambda ring: F.transform(ring, up)))
    walls = F.flatten(F.transform(base, lambda ring: F.transform(
        F.sequence(F.lit(0), F.size(ring) - 2),
        lambda i: F.array(F.array(ring[i], ring[i + 1], up(ring[i + 1]), up(ring[i]), ring[i])))))
    faces = F.concat(floor, roof, walls)
    return make_geom("POLYHEDRALSURFACE", faces, g["srid"])


def st_dump(geom) -> Column:
    """Array of single-part geometries (POLYGON per face / part); use with ``posexplode``."""
    g = as_col(geom)
    single = F.when(g["type"].isin("MULTIPOLYGON", "POLYHEDRALSURFACE", "TIN", "POLYGON"), F.lit("POLYGON")) \
        .when(g["type"].isin("MULTILINESTRING", "LINESTRING"), F.lit("LINESTRING")).otherwise(F.lit("POINT"))
    return F.transform(g["parts"], lambda part: make_geom(single, F.array(part), g["srid"]))


def geometry_type(geom) -> Column:
    """G13."""
    return as_col(geom)["type"]


def st_make_valid(geom) -> Column:
    """G9 (limited): drop consecutive duplicate vertices, close rings, orient shells CCW / holes CW,
    drop rings with fewer than 4 points.  Self-intersections need ``operators.union.make_valid``."""
    g = as_col(geom)

    def dedupe(ring):
        idx = F.sequence(F.lit(1), F.size(ring))
        kept = F.filter(idx, lambda i: (i == 1) | (ring[i - 1] != ring[i - 2]))
        return F.transform(kept, lambda i: ring[i - 1])

    def close(ring):
        return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(ring[0])))

    def orient(ring, shell: Column):
        a = ring_signed_area(ring)
        return F.when((shell & (a < 0)) | (~shell & (a > 0)), F.reverse(ring)).otherwise(ring)

    def fix_part(part):
        cleaned = F.transform(part, lambda r: close(dedupe(r)))
        valid = F.filter(cleaned, lambda r: F.size(r) >= 4)
        return F.transform(valid, lambda r, i: orient(r, i == 0))

    areal = g["type"].isin("POLYGON", "MULTIPOLYGON")
    parts = F.filter(F.transform(g["parts"], fix_part), lambda p: F.size(p) > 0)
    return F.when(areal, g.withField("parts", parts)).otherwise(g)


def force_geometry_type(geom, gtype: str) -> Column:
    """Promote single → multi freely; demoting a multi with >1 part gives NULL."""
    g = as_col(geom)
    t = gtype.upper()
    if t.startswith("MULTI"):
        return g.withField("type", F.lit(t))
    return F.when(F.size(g["parts"]) <= 1, g.withField("type", F.lit(t)))


def assign_srid(geom, srid: int) -> Column:
    """Label coordinates with an SRID (no change of values)."""
    return as_col(geom).withField("srid", F.lit(srid).cast("int"))


# --- text ------------------------------------------------------------------------------------

def num_text(c: Column) -> Column:
    """Coordinate text: integral values without ``.0`` (as PostGIS prints them)."""
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def _coord(p: Column, with_z: Column) -> Column:
    xy = F.concat_ws(" ", num_text(p["x"]), num_text(p["y"]))
    return F.when(with_z & p["z"].isNotNull(), F.concat_ws(" ", xy, num_text(p["z"]))).otherwise(xy)


def st_astext(geom) -> Column:
    """WKT (``POLYGON Z`` when vertices carry z)."""
    g = as_col(geom)
    has_z = F.exists(vertices(g), lambda p: p["z"].isNotNull())
    ring_t = lambda ring: F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: _coord(p, has_z)), ","), F.lit(")"))
    part_t = lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, ring_t), ","), F.lit(")"))
    t = g["type"]
    body = (F.when(t == "POINT", F.concat(F.lit("("), _coord(g["parts"][0][0][0], has_z), F.lit(")")))
            .when(t == "LINESTRING", ring_t(g["parts"][0][0]))
            .when(t == "POLYGON", part_t(g["parts"][0]))
            .when(t == "MULTILINESTRING", F.concat(F.lit("("), F.array_join(F.transform(g["parts"], lambda pt: ring_t(pt[0])), ","), F.lit(")")))
            .otherwise(F.concat(F.lit("("), F.array_join(F.transform(g["parts"], part_t), ","), F.lit(")"))))
    return F.concat(t, F.when(has_z, F.lit(" Z ")).otherwise(F.lit(" ")), body)


def wkt_literal(geom) -> Column:
    """G11 + CRS prefix, the ``geo:wktLiteral`` lexical form."""
    g = as_col(geom)
    return F.concat(F.lit("<http://www.opengis.net/def/crs/EPSG/0/"), g["srid"].cast("string"), F.lit("> "), st_astext(g))
