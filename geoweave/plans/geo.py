"""Geometry, CRS and 3D-city queries on stand-in geometry derived from the driver tables.

Stand-in: every part is a building whose footprint is the rectangle
``[x0, x0+w] × [y0, y0+d]`` with ``x0 = (key % 100)·100``, ``y0 = floor(key/100)·100``,
``w = p_size``, ``d = key % 7 + 1``; height ``p_size``, elevation ``key % 5``.
Integral coordinates keep the WKT text identical across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import crs, geom as G
from geoweave.operators import city as C
from geoweave.operators.union import make_valid, union_agg
from geoweave.plans.registry import query
from geoweave.plans.relational import UUID_SQL
from geoweave.plans.sqlmath import sql_transform
from geoweave.plans.tables import read
from geoweave.session import dealt, shuffled

EX_CITY = "https://example.org/city/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_DOUBLE = "http://www.w3.org/2001/XMLSchema#double"
X0 = "(p_partkey % 100) * 100"
Y0 = "floor(p_partkey / 100) * 100"
W = "p_size"
D = "(p_partkey % 7 + 1)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dealt(read(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    k = F.col("p_partkey")
    return p.select("p_partkey", "p_size",
                    ((k % 100) * 100).cast("double").alias("x0"), (F.floor(k / 100) * 100).cast("double").alias("y0"),
                    F.col("p_size").cast("double").alias("w"), (k % 7 + 1).cast("double").alias("d"),
                    (k % 5).cast("double").alias("elev"))


def footprint(df: DataFrame, z=None, srid=27700):
    return G.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("d"), z, srid)


def _num(expr: str) -> str:
    return f"CAST(CAST({expr} AS BIGINT) AS VARCHAR)"


@query("polygon_area", f"""
SELECT p_partkey,
       round({W} * {D} - CASE WHEN p_size > 25 THEN ({W} / 4.0) * ({D} / 4.0) ELSE 0 END, 6) AS area,
       CASE WHEN p_size > 25 THEN 10 ELSE 5 END AS n_points
FROM part
""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: shoelace area, shell minus holes (a quarter-size hole for p_size > 25)."""
    b = boxes(spark, sf_dir)
    shell = footprint(b)["parts"][0][0]
    hole = G.box(F.col("x0") + F.col("w") / 4, F.col("y0") + F.col("d") / 4,
                 F.col("x0") + F.col("w") / 2, F.col("y0") + F.col("d") / 2)["parts"][0][0]
    rings = F.when(F.col("p_size") > 25, F.array(shell, F.reverse(hole))).otherwise(F.array(shell))
    g = G.make_geom("POLYGON", F.array(rings), 27700)
    return b.select("p_partkey", F.round(G.st_area(g), 6).alias("area"), G.st_npoints(g).alias("n_points"))


def _box_wkt_sql(x0, y0, x1, y1, z=None) -> str:
    def pt(x, y):
        s = f"{_num(x)} || ' ' || {_num(y)}"
        return s if z is None else f"{s} || ' ' || {_num(z)}"
    pts = " || ',' || ".join(pt(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))
    head = "'POLYGON ((' || " if z is None else "'POLYGON Z ((' || "
    return f"{head}{pts} || '))'"


@query("polygon_wkt", f"""
SELECT p_partkey, {_box_wkt_sql(X0, Y0, f'{X0} + {W}', f'{Y0} + {D}')} AS wkt,
       '<http://www.opengis.net/def/crs/EPSG/0/27700> ' || {_box_wkt_sql(X0, Y0, f'{X0} + {W}', f'{Y0} + {D}')} AS wkt_literal
FROM part
""")
def polygon_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WKT and CRS-prefixed ``geo:wktLiteral`` text."""
    b = boxes(spark, sf_dir)
    g = footprint(b)
    return b.select("p_partkey", G.st_astext(g).alias("wkt"), G.wkt_literal(g).alias("wkt_literal"))


@query("flip_translate", f"""
SELECT p_partkey, CAST({Y0} + 1000.0 AS DOUBLE) AS xmin, CAST({X0} - 500.0 AS DOUBLE) AS ymin,
       CAST({Y0} + {D} + 1000.0 AS DOUBLE) AS xmax, CAST({X0} + {W} - 500.0 AS DOUBLE) AS ymax
FROM part
""")
def flip_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swap axes, shift, then bounding box."""
    b = boxes(spark, sf_dir)
    g = G.st_translate(G.st_flip_coordinates(footprint(b)), 1000.0, -500.0)
    return b.select("p_partkey", G.st_xmin(g).alias("xmin"), G.st_ymin(g).alias("ymin"),
                    G.st_xmax(g).alias("xmax"), G.st_ymax(g).alias("ymax"))


@query("zrange", """
SELECT p_partkey, CAST(p_partkey % 5 AS DOUBLE) AS zmin, CAST(p_partkey % 5 + p_size AS DOUBLE) AS zmax,
       6 AS n_faces
FROM part
""")
def zrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift to z = elevation, extrude by height, z range and face count."""
    b = boxes(spark, sf_dir)
    solid = G.st_extrude(G.st_force3d(footprint(b), F.col("elev")), F.col("w"))
    return b.select("p_partkey", G.st_zmin(solid).alias("zmin"), G.st_zmax(solid).alias("zmax"),
                    F.size(solid["parts"]).alias("n_faces"))


def raw_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    b = b.withColumn("fp", footprint(b)).withColumn("gml", F.concat(F.lit("bldg_"), F.col("p_partkey").cast("string")))
    return C.to_raw_buildings(b, {"id": "p_partkey", "polygon": "fp", "height": "w", "elevation": "elev", "gmlid": "gml"})


@query("extrude_surfaces", f"""
SELECT 'bldg_' || CAST(p_partkey AS VARCHAR) AS building_gmlid, c AS class, CAST(n AS BIGINT) AS n_faces, area
FROM part, (VALUES (35, 1, 1.0), (33, 1, 1.0), (34, 4, 0.0)) t(c, n, f)
CROSS JOIN LATERAL (SELECT CAST(round(f * {W} * {D}, 6) AS DOUBLE) AS area)
""")
def extrude_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + C3: extruded solids dumped to classified surfaces; per building & class: faces, 2D area."""
    s = C.to_raw_surfaces(raw_buildings(spark, sf_dir))
    return s.groupBy("building_gmlid", "class").agg(F.count(F.lit(1)).alias("n_faces"),
                                                   F.round(F.sum(G.st_area("geom")), 6).alias("area"))


@query("surface_classes", """
SELECT c AS class, count(*) * n AS n_faces FROM part, (VALUES (35, 1), (33, 1), (34, 4)) t(c, n) GROUP BY c, n
""")
def surface_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes re-discovered from geometry alone (Newell normals) match the construction."""
    s = C.to_raw_surfaces(raw_buildings(spark, sf_dir)).drop("class")
    return C.discover_surfaces(s).groupBy("class").agg(F.count(F.lit(1)).alias("n_faces"))


@query("building_height", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_size + 1.0 ELSE CAST(p_size AS DOUBLE) END AS measured_height
FROM part
""")
def building_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 + J12: fill missing measured heights from face z-range (only where NULL)."""
    b = boxes(spark, sf_dir)
    building = b.select(F.col("p_partkey").alias("id"),
                        F.when(F.col("p_partkey") % 2 == 1, F.col("w") + 1.0).alias("measured_height"))
    faces = C.to_raw_surfaces(raw_buildings(spark, sf_dir)).select(
        F.regexp_extract("building_gmlid", r"(\d+)$", 1).cast("bigint").alias("building_id"), F.col("geom").alias("geometry"))
    out = C.add_building_height(building, faces)
    return out.select(F.col("id").alias("p_partkey"), "measured_height")


def city_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stand-in 3DCityDB tables: key % 3 = 0 has a footprint; = 1 ground faces (two halves); = 2 roof + walls."""
    b = boxes(spark, sf_dir)
    k = F.col("p_partkey")
    half = F.col("w") / 2
    kind = k % 3
    # ground faces (kind 1) lie at the elevation, roof faces (kind 2) one height above it
    z = F.when(kind == 1, F.col("elev")).otherwise(F.col("elev") + F.col("w"))
    left = G.box(F.col("x0"), F.col("y0"), F.col("x0") + half, F.col("y0") + F.col("d"), z)
    right = G.box(F.col("x0") + half, F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("d"), z)
    wall = G.make_geom("POLYGON", F.array(F.array(F.array(
        G.vertex(F.col("x0"), F.col("y0"), F.col("elev")), G.vertex(F.col("x0") + F.col("w"), F.col("y0"), F.col("elev")),
        G.vertex(F.col("x0") + F.col("w"), F.col("y0"), F.col("elev") + F.col("w")),
        G.vertex(F.col("x0"), F.col("y0"), F.col("elev") + F.col("w")), G.vertex(F.col("x0"), F.col("y0"), F.col("elev"))))))
    # surfaces: (surface id, class, geometry); ids: 10*key + n (n = 1..4), own footprint 10*key + 9
    faces = b.select("p_partkey", kind.alias("kind"), F.explode(F.array(
        F.struct(F.lit(1).alias("n"), F.when(kind == 1, F.lit(35)).otherwise(F.lit(33)).alias("cls"),
                 left.alias("g")),
        F.struct(F.lit(2).alias("n"), F.when(kind == 1, F.lit(35)).otherwise(F.lit(33)).alias("cls"),
                 right.alias("g")),
        F.struct(F.lit(3).alias("n"), F.lit(34).alias("cls"), wall.alias("g")))).alias("f"))
    faces = faces.where(F.col("kind") != 0).select(
        "p_partkey", (F.col("p_partkey") * 10 + F.col("f.n")).alias("sid"), F.col("f.cls").alias("cls"), F.col("f.g").alias("g"))
    own = b.where(kind == 0).select("p_partkey", (F.col("p_partkey") * 10 + 9).alias("sid"),
                                    G.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("d"),
                                          F.col("elev"), 27700).alias("g"))
    building = b.select(F.col("p_partkey").alias("id"),
                        F.when(kind == 0, F.col("p_partkey") * 10 + 9).alias("lod0_footprint_id"),
                        F.lit(None).cast("bigint").alias("lod2_multi_surface_id"),
                        F.lit(None).cast("bigint").alias("lod2_solid_id"),
                        F.when(k % 2 == 1, F.col("w")).alias("measured_height"))
    cityobject = b.select(F.col("p_partkey").alias("id"), F.concat(F.lit("bldg_"), k.cast("string")).alias("gmlid"),
                          G.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("d"),
                                F.col("elev")).alias("envelope"),
                          F.lit(26).alias("objectclass_id"), F.lit("stand-in").alias("lineage"))
    thematic = faces.select(F.col("sid").alias("id"), F.col("p_partkey").alias("building_id"),
                            F.col("sid").alias("lod2_multi_surface_id"), F.col("cls").alias("objectclass_id"))
    sg_cols = lambda df: df.select(F.col("sid").alias("id"), F.concat(F.lit("sg_"), F.col("sid").cast("string")).alias("gmlid"),
                                   F.lit(None).cast("bigint").alias("parent_id"), F.col("sid").alias("root_id"),
                                   F.col("g").alias("geometry"), F.col("p_partkey").alias("cityobject_id"))
    surfaces = sg_cols(faces).unionByName(sg_cols(own))
    return {"building": building, "cityobject": cityobject, "thematic_surface": thematic, "surface_geometry": surfaces}


@query("footprint_precise_rough", f"""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 'precise' ELSE 'rough' END AS kind,
       round(CAST({W} * {D} AS DOUBLE), 6) AS area, 4 AS n_vertices
FROM part WHERE p_partkey % 3 <> 0
""")
def footprint_precise_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground faces → precise footprint; roofs (walls have zero 2D area) → rough footprint."""
    t = city_tables(spark, sf_dir)
    _b, _sg, fps = C.add_footprint(t["building"], t["cityobject"], t["thematic_surface"], t["surface_geometry"], 27700)
    return fps.select("id", "kind", F.round(G.st_area("geom"), 6).alias("area"),
                      (G.st_npoints("geom") - F.size(F.col("geom")["parts"])).alias("n_vertices"))


def _wkt_sql(points, z=None) -> str:
    def pt(x, y):
        t = f"{_num(x)} || ' ' || {_num(y)}"
        return t if z is None else f"{t} || ' ' || {_num(z)}"
    head = "'POLYGON ((' || " if z is None else "'POLYGON Z ((' || "
    return head + " || ',' || ".join(pt(x, y) for x, y in points) + " || '))'"


def _flipped_box_wkt_sql() -> str:
    x1, y1 = f"{X0} + {W}", f"{Y0} + {D}"
    return _wkt_sql([(Y0, X0), (Y0, x1), (y1, x1), (y1, X0), (Y0, X0)], z="p_partkey % 5")


@query("footprint_layer", f"""
SELECT p_partkey AS building_id,
       CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS DOUBLE) ELSE 100.0 END AS building_height,
       {_flipped_box_wkt_sql()} AS wkt,
       {UUID_SQL.format(c="p_partkey")} AS uuid,
       'https://example.org/kg/Building/' || CAST(p_partkey AS VARCHAR) AS iri
FROM part WHERE p_partkey % 4 <> 3
""")
def footprint_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 → C8 (+G4): footprints created where missing, joined to uuid/iri attributes, axes flipped."""
    from geoweave.functions.pgcompat import stable_uuid

    t = city_tables(spark, sf_dir)
    b2, sg2, _fps = C.add_footprint(t["building"], t["cityobject"], t["thematic_surface"], t["surface_geometry"], 27700)
    ids = t["building"].where(F.col("id") % 4 != 3).select("id")
    attrs = ids.select(F.col("id").alias("cityobject_id"), F.lit("uuid").alias("attrname"),
                       stable_uuid("id").alias("strval"), F.lit(None).cast("string").alias("urival")).unionByName(
        ids.select(F.col("id").alias("cityobject_id"), F.lit("iri").alias("attrname"), F.lit(None).cast("string").alias("strval"),
                   F.concat(F.lit("https://example.org/kg/Building/"), F.col("id").cast("string")).alias("urival")))
    layer = C.footprint_layer(b2, sg2, attrs, flip=True)
    return layer.select("building_id", "building_height", G.st_astext("geometry").alias("wkt"), "uuid", "iri")


@query("import_skip", """
WITH existing AS (
  SELECT 'bldg_' || CAST(p_partkey AS VARCHAR) AS gmlid, CASE WHEN p_partkey % 5 = 0 THEN 'keep' ELSE 'old' END AS lineage
  FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 0),
kept AS (SELECT * FROM existing WHERE lineage <> 'old')
SELECT * FROM kept
UNION ALL
SELECT 'bldg_' || CAST(p_partkey AS VARCHAR), 'old' FROM part
WHERE p_partkey % 3 <> 0 AND 'bldg_' || CAST(p_partkey AS VARCHAR) NOT IN (SELECT gmlid FROM kept)
""")
def import_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-import lineage 'old' (non-append): lineage deleted first, known gmlids skipped."""
    p = read(spark, sf_dir, "part", "p_partkey")
    gml = F.concat(F.lit("bldg_"), F.col("p_partkey").cast("string")).alias("gmlid")
    existing = p.where((F.col("p_partkey") % 2 == 0) | (F.col("p_partkey") % 5 == 0)).select(
        gml, F.when(F.col("p_partkey") % 5 == 0, F.lit("keep")).otherwise(F.lit("old")).alias("lineage"))
    incoming = p.where(F.col("p_partkey") % 3 != 0).select(gml)
    return C.import_objects(existing, incoming, "old", append=False).select("gmlid", "lineage")


@query("stable_iris", f"""
SELECT 'bldg_' || CAST(p_partkey AS VARCHAR) AS gmlid,
       CASE WHEN p_partkey % 2 = 0 THEN 'prev-' || CAST(p_partkey AS VARCHAR)
            ELSE {UUID_SQL.format(c="'bldg_' || CAST(p_partkey AS VARCHAR)")} END AS uuid,
       CASE WHEN p_partkey % 2 = 0 THEN 'https://example.org/old/' || CAST(p_partkey AS VARCHAR)
            ELSE 'https://example.org/kg/Building/' || {UUID_SQL.format(c="'bldg_' || CAST(p_partkey AS VARCHAR)")} END AS iri
FROM part
""")
def stable_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids survive re-import — previous snapshot values win over freshly minted ones."""
    p = read(spark, sf_dir, "part", "p_partkey")
    objs = p.select(F.concat(F.lit("bldg_"), F.col("p_partkey").cast("string")).alias("gmlid"))
    prev = p.where(F.col("p_partkey") % 2 == 0).select(
        F.concat(F.lit("bldg_"), F.col("p_partkey").cast("string")).alias("gmlid"),
        F.concat(F.lit("prev-"), F.col("p_partkey").cast("string")).alias("uuid"),
        F.concat(F.lit("https://example.org/old/"), F.col("p_partkey").cast("string")).alias("iri"))
    return C.add_iris(objs, "https://example.org/kg/", prev)


# --- coordinate reference systems ---------------------------------------------------------------

SUP_LON = "(s_suppkey % 360) - 179.5"
SUP_LAT = "(s_suppkey % 170) - 84.75"


def _crs_sql(table: str, key: str, lon: str, lat: str, dst: int, names=("x", "y"), z: bool = False) -> str:
    inner = sql_transform(f"SELECT {key}, {lon} AS lon, {lat} AS lat FROM {table}", [key], "lon", "lat", 4326, dst)
    cols = f"round(x, 3) AS {names[0]}, round(y, 3) AS {names[1]}" + (", round(z, 3) AS z" if z else "")
    return f"SELECT {key}, {cols} FROM ({inner})"


def _crs_point(df: DataFrame, key: str, lon, lat, dst: int, names=("x", "y"), z: bool = False) -> DataFrame:
    v = crs.st_transform(G.point(lon, lat, srid=4326), dst, 4326)["parts"][0][0][0]
    cols = [F.round(v["x"], 3).alias(names[0]), F.round(v["y"], 3).alias(names[1])]
    if z:
        cols.append(F.round(v["z"], 3).alias("z"))
    return df.select(key, *cols)


@query("reproject_mercator", f"""
SELECT s_suppkey, round(6378137.0 * radians({SUP_LON}), 3) AS x,
       round(6378137.0 * ln(tan(pi() / 4 + radians({SUP_LAT}) / 2)), 3) AS y FROM supplier
""")
def reproject_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPSG:4326 → 3857 on every vertex."""
    k = F.col("s_suppkey")
    return _crs_point(read(spark, sf_dir, "supplier", "s_suppkey"), "s_suppkey", (k % 360) - 179.5, (k % 170) - 84.75, 3857)


CUS_LON = "(c_custkey % 360) - 179.5"
CUS_LAT = "(c_custkey % 170) - 84.75"


@query("geocentric", f"""
WITH p AS (SELECT c_custkey, radians({CUS_LON}) AS l, radians({CUS_LAT}) AS f, 0.0066943799901413165 AS e2 FROM customer),
n AS (SELECT *, 6378137.0 / sqrt(1 - e2 * sin(f) ** 2) AS n FROM p)
SELECT c_custkey, round(n * cos(f) * cos(l), 3) AS x, round(n * cos(f) * sin(l), 3) AS y, round(n * (1 - e2) * sin(f), 3) AS z FROM n
""")
def geocentric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPSG:4326 → 4978 (earth-centred XYZ, the 3D-tiles frame)."""
    k = F.col("c_custkey")
    return _crs_point(read(spark, sf_dir, "customer", "c_custkey"), "c_custkey", (k % 360) - 179.5, (k % 170) - 84.75,
                      4978, z=True)


BNG_LON = "(-7.0 + (c_custkey % 80) / 10.0)"
BNG_LAT = "(50.0 + (c_custkey % 90) / 10.0)"


@query("reproject_bng", _crs_sql("customer", "c_custkey", BNG_LON, BNG_LAT, 27700, ("e", "n")))
def reproject_bng(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WGS84 → British National Grid (Helmert datum shift + transverse Mercator)."""
    k = F.col("c_custkey")
    return _crs_point(read(spark, sf_dir, "customer", "c_custkey"), "c_custkey", -7.0 + (k % 80) / 10.0,
                      50.0 + (k % 90) / 10.0, 27700, ("e", "n"))


UTM_LON = "(6.0 + (s_suppkey % 60) / 10.0)"
UTM_LAT = "(45.0 + (s_suppkey % 100) / 10.0)"


@query("reproject_utm", _crs_sql("supplier", "s_suppkey", UTM_LON, UTM_LAT, 25832, ("e", "n")))
def reproject_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETRS89 / UTM zone 32N."""
    k = F.col("s_suppkey")
    return _crs_point(read(spark, sf_dir, "supplier", "s_suppkey"), "s_suppkey", 6.0 + (k % 60) / 10.0,
                      45.0 + (k % 100) / 10.0, 25832, ("e", "n"))


@query("tile_assign", f"""
WITH pts AS (SELECT CAST({CUS_LON} AS DOUBLE) AS lon, CAST({CUS_LAT} AS DOUBLE) / 1.2 AS lat FROM customer),
t AS (SELECT lon, lat,
        CAST(least(greatest(floor((lon + 180.0) / 360.0 * 256.0), 0), 255) AS INTEGER) AS tile_x,
        CAST(least(greatest(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / 3.141592653589793) / 2.0 * 256.0), 0), 255) AS INTEGER) AS tile_y
      FROM pts)
SELECT tile_x, tile_y, count(*) AS n_features, min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max
FROM t GROUP BY tile_x, tile_y
""")
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web-Mercator tile per feature (zoom 8), per-tile counts and bounds in one aggregate."""
    c = read(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    pts = c.select(((k % 360) - 179.5).alias("lon"), (((k % 170) - 84.75) / 1.2).alias("lat"))
    return C.assign_tiles(pts, "lon", "lat", 8)


@query("merge_parts", """
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN p_partkey - 1 END AS rel,
                  CASE WHEN p_size > 10 THEN p_size END AS height FROM part),
kept AS (SELECT * FROM p WHERE rel IS NOT NULL OR height IS NOT NULL OR id IN (SELECT rel FROM p WHERE rel IS NOT NULL))
SELECT COALESCE(rel, id) AS parent, round(avg(height), 6) AS average_height, CAST(50.0 AS DOUBLE) AS elevation,
       CAST(count(*) AS DOUBLE) AS area, 4 AS n_vertices, CAST(0 AS BIGINT) AS overlap_edges
FROM kept GROUP BY 1 HAVING avg(height) IS NOT NULL
""")
def merge_parts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 (+P9/P5/A1/G8): building parts (pairs of unit squares side by side) merged per parent."""
    p = dealt(read(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    k = F.col("p_partkey")
    x0 = (F.floor(k / 2) * 10 + k % 2).cast("double")
    parts = p.select(k.alias("id"), F.when(k % 2 == 1, k - 1).alias("rel"),
                     F.when(F.col("p_size") > 10, F.col("p_size")).alias("height"),
                     G.box(x0, F.lit(0.0), x0 + 1.0, F.lit(1.0), srid=4326).alias("geom"))
    m = C.merge_parts(parts, srid=4326)
    return m.select("parent", F.round("average_height", 6).alias("average_height"), "elevation",
                    G.st_area("geometry").alias("area"),
                    (G.st_npoints("geometry") - F.size(F.col("geometry")["parts"])).alias("n_vertices"), "overlap_edges")


@query("city_attributes", """
WITH b AS (SELECT p_partkey, p_brand, p_size, 'https://example.org/type/' || p_partkey AS link,
    row_number() OVER (ORDER BY 'bldg_' || lpad(p_partkey::VARCHAR, 12, '0')) AS id FROM part WHERE p_size > 0)
SELECT id AS cityobject_id, 'p_brand' AS attrname, p_brand AS strval, NULL::VARCHAR AS urival FROM b WHERE p_brand IS NOT NULL
UNION ALL SELECT id, 'half', (p_size // 2)::VARCHAR, NULL FROM b WHERE p_size % 2 = 0
UNION ALL SELECT id, 'link', NULL, link FROM b
""")
def city_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: generic attribute rows of the imported buildings, texts, numbers (NULL for odd sizes) and IRIs."""
    k = F.col("p_partkey")
    p = boxes(spark, sf_dir).join(shuffled(read(spark, sf_dir, "part", "p_partkey", "p_brand")), "p_partkey").select(
        k.alias("id"), F.concat(F.lit("bldg_"), F.lpad(k.cast("string"), 12, "0")).alias("gmlid"), footprint(None).alias("footprint"),
        F.col("p_size").alias("height"), "p_brand", F.when(F.col("p_size") % 2 == 0, F.floor(F.col("p_size") / 2)).alias("half"),
        F.concat(F.lit("https://example.org/type/"), k.cast("string")).alias("link"))
    keep = ["p_brand", "half", "link"]
    raw = C.to_raw_buildings(p, {"id": "id", "gmlid": "gmlid", "footprint": "footprint", "height": "height"}, keep=keep)
    return C.populate_city_tables(raw, C.to_raw_surfaces(raw), "load", attributes=keep)["cityobject_genericattrib"]


@query("city_triples", f"""
WITH b AS (SELECT p_partkey AS id FROM part)
SELECT NULL::VARCHAR AS g, '{EX_CITY}Building/' || CAST(id AS VARCHAR) AS s, '{RDF_TYPE}' AS p, '{EX_CITY}Building' AS o,
       'iri' AS o_kind, NULL::VARCHAR AS o_dtype, NULL::VARCHAR AS o_lang FROM b
UNION ALL SELECT NULL, '{EX_CITY}Building/' || CAST(id AS VARCHAR), '{EX_CITY}gmlId', 'bldg_' || CAST(id AS VARCHAR),
       'literal', NULL, NULL FROM b
UNION ALL SELECT NULL, '{EX_CITY}Building/' || CAST(p_partkey AS VARCHAR), '{EX_CITY}measuredHeight',
       CAST(CAST(p_size AS DOUBLE) AS VARCHAR), 'literal', '{XSD_DOUBLE}', NULL FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT NULL, '{EX_CITY}Building/' || CAST(p_partkey AS VARCHAR), '{EX_CITY}lod0Footprint',
       '{EX_CITY}SurfaceGeometry/' || CAST(p_partkey * 10 + 9 AS VARCHAR), 'iri', NULL, NULL FROM part WHERE p_partkey % 3 = 0
""")
def city_triples_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building object-tree attributes of the stand-in city tables as triples."""
    t = city_tables(spark, sf_dir)
    return C.city_triples(t["building"], t["cityobject"], EX_CITY)


@query("union_overlaps", """
WITH p AS (SELECT p_partkey AS k, p_size % 7 + 2 AS w, p_size % 5 + 2 AS h FROM part)
SELECT k, CAST(w * 4 + 4 * h - least(w, 4) * least(h, 4) + 6 AS DOUBLE) AS area, 1 AS n_parts, 0 AS n_holes FROM p
""")
def union_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 on shapes that overlap (two bars in an L), touch along part of an edge (T-junction) and lie inside each other."""
    p = dealt(read(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    w, h, z = (F.col("p_size") % 7 + 2).cast("double"), (F.col("p_size") % 5 + 2).cast("double"), F.lit(0.0)
    faces = F.array(G.box(z, z, w, F.lit(4.0)), G.box(z, z, F.lit(4.0), h), G.box(F.lit(-2.0), F.lit(0.5), z, F.lit(3.5)),
                    G.box(F.lit(0.25), F.lit(0.25), F.lit(0.75), F.lit(0.75)))
    u = union_agg(p.select(F.col("p_partkey").alias("k"), F.explode(faces).alias("geom")), "k")
    rings = F.aggregate(F.transform(F.col("geom")["parts"], F.size), F.lit(0), lambda a, b: a + b)
    n = F.size(F.col("geom")["parts"])
    return u.select("k", F.round(G.st_area("geom"), 6).alias("area"), n.alias("n_parts"), (rings - n).alias("n_holes"))


def _there_and_back(df: DataFrame, key: str, lon, lat, code: int) -> DataFrame:
    away = crs.st_transform(G.point(lon, lat, srid=4326), code, 4326)
    v = crs.st_transform(away, 4326, code)["parts"][0][0][0]
    return df.select(key, F.round(v["x"], 5).alias("lon"), F.round(v["y"], 5).alias("lat"))


@query("reproject_bng_back", f"SELECT c_custkey, round({BNG_LON}, 5) AS lon, round({BNG_LAT}, 5) AS lat FROM customer")
def reproject_bng_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WGS84 → British National Grid → WGS84; the oracle is the coordinates one began with."""
    k = F.col("c_custkey")
    return _there_and_back(read(spark, sf_dir, "customer", "c_custkey"), "c_custkey", -7.0 + (k % 80) / 10.0, 50.0 + (k % 90) / 10.0, 27700)


@query("reproject_utm_back", f"SELECT s_suppkey, round({UTM_LON}, 5) AS lon, round({UTM_LAT}, 5) AS lat FROM supplier")
def reproject_utm_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geographic → UTM zone 32N → geographic."""
    k = F.col("s_suppkey")
    return _there_and_back(read(spark, sf_dir, "supplier", "s_suppkey"), "s_suppkey", 6.0 + (k % 60) / 10.0, 45.0 + (k % 100) / 10.0, 25832)


@query("union_large_feature", """
WITH c AS (SELECT DISTINCT floor(p_partkey / 100) AS y, 2 * (p_partkey % 100) + u AS x FROM part, (SELECT unnest([0, 1, 2]) AS u)),
b AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS run FROM c)
SELECT 'all' AS k, count(*) / 2 AS area, (SELECT count(DISTINCT y % 2) FROM c) AS n_rows FROM b
""")
def union_large_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as the overlapping faces of one feature, a grid of cells over it."""
    k = F.col("p_partkey")
    x, y = (k % 100).cast("double"), F.floor(k / 100).cast("double")
    faces = dealt(read(spark, sf_dir, "part", "p_partkey"), "p_partkey").select(F.lit("all").alias("k"), G.box(x, y, x + 1.5, y + 1.0).alias("geom"), (y % 2).alias("y"))
    rows = faces.groupBy("k").agg(F.count_distinct("y").alias("n_rows"))
    return union_agg(faces, "k", small=100).join(rows, "k").select("k", F.round(G.st_area("geom"), 6).alias("area"), "n_rows")


def _ring(*xy) -> F.Column:
    points = [G.vertex(x, y) for x, y in xy]
    return F.array(*points, points[0])


@query("make_valid_bowtie", """
WITH p AS (SELECT p_partkey AS k, p_size % 9 + 2 AS w, p_size % 5 + 2 AS h FROM part)
SELECT k, CASE k % 4 WHEN 0 THEN w * h / 2 WHEN 1 THEN w * h + 1 WHEN 2 THEN 0 ELSE w * h - 1 END AS area,
  CASE k % 4 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS n_parts FROM p
""")
def make_valid_bowtie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow ties, holes beside their shell, spikes without area, shells given twice around a hole."""
    p = dealt(read(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    k, w, h, z = F.col("p_partkey"), (F.col("p_size") % 9 + 2).cast("double"), (F.col("p_size") % 5 + 2).cast("double"), F.lit(0.0)
    shell = _ring((z, z), (w, z), (w, h), (z, h))
    unit = lambda x: _ring((x, z + 0.5), (x + 1, z + 0.5), (x + 1, z + 1.5), (x, z + 1.5))
    shapes = [F.array(F.array(_ring((z, z), (w, h), (w, z), (z, h)))), F.array(F.array(shell, unit(w + 1))), F.array(F.array(_ring((z, z), (w, h), (w, h)))),
              F.array(F.array(shell, unit(z + 0.5)), F.array(shell, unit(z + 0.5)))]
    parts = F.when(k % 4 == 0, shapes[0]).when(k % 4 == 1, shapes[1]).when(k % 4 == 2, shapes[2]).otherwise(shapes[3])
    rows = p.select(k.alias("k"), G.make_geom("MULTIPOLYGON", parts).alias("geom"))
    return make_valid(rows, "k").select("k", F.round(G.st_area("geom"), 6).alias("area"), F.size(F.col("geom")["parts"]).alias("n_parts"))
