"""Queries on readers, writers and small operators: whole driver tables written to the scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import geom as G
from geoweave.functions import terms as T
from geoweave.operators import city, hooks, relational
from geoweave.plans.geo import _ring
from geoweave.plans.registry import query
from geoweave.plans.tables import read
from geoweave.session import ensure_checkpoint_dir
from geoweave.sources import features, osm, tabular, tbox

EX = "https://example.org/kg/"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("tabular_roundtrip", """
SELECT c_custkey::BIGINT AS c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS "the name", CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 0.5 END AS half
FROM customer
""")
def tabular_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as semicolon-separated files with empty values, read back with detected types and a verbatim header."""
    k, path = F.col("c_custkey"), scratch(spark, "csv")
    rows = read(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        "c_custkey", F.when(k % 3 > 0, F.col("c_name")).alias("the name"), F.when(k % 2 == 0, k * 0.5).alias("half"))
    rows.write.option("header", "true").option("sep", ";").csv(path)
    return tabular.read_tabular(spark, path, sep=";").select(F.col("c_custkey").cast("long").alias("c_custkey"), "the name", "half")


@query("append_layers", """
SELECT 'customer' AS layer, c_custkey AS id, c_nationkey AS nation, NULL::VARCHAR AS name FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_name FROM supplier
""")
def append_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two layers, one with a column more, read as one; a column that a file lacks is NULL."""
    path = scratch(spark, "layers")
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    for name, df in (("customer", a), ("supplier", b)):
        tabular.write_table(df, f"{path}/{name}")
    both = tabular.read_files(spark, [f"{path}/customer", f"{path}/supplier"], "parquet", recursiveFileLookup="true")
    return tabular.select_fields(both.withColumn("layer", F.element_at(F.split("_source", "/"), -2)), "layer, id, nation,name")


@query("files_by_driver", """
SELECT 'CSV' AS driver, (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'GeoJSON', (SELECT count(*) FROM customer)
""")
def files_by_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, A5: a folder of mixed files scanned and grouped by driver, each group read by its own reader."""
    path = scratch(spark, "mixed")
    read(spark, sf_dir, "supplier", "s_suppkey").write.option("header", "true").csv(f"{path}/a")
    read(spark, sf_dir, "customer", "c_custkey").write.json(f"{path}/b/c")
    groups = {r.driver: r.paths for r in tabular.group_by_driver(tabular.scan_files(spark, path)).collect()}  # a few files
    counts = [tabular.read_files(spark, groups[d], f, s, **o).agg(F.lit(d).alias("driver"), F.count("*").alias("n"))
              for d, f, s, o in (("CSV", "csv", "s_suppkey long", {"header": "true"}), ("GeoJSON", "json", "c_custkey long", {}))]
    return counts[0].unionByName(counts[1])


@query("write_partitions", """
SELECT o_orderstatus AS status, 2 * count(*) AS n, CAST(2 * sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1
""")
def write_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrite, then append, partitioned by status; the overwrite leaves nothing of an earlier table."""
    path = scratch(spark, "table")
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderstatus", "status")
    for mode in ("append", "overwrite", "append"):
        tabular.write_table(rows, path, mode, ["status"])
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("geometry_labels", """
SELECT p_partkey AS k, 'MULTIPOLYGON' AS multi, CASE WHEN p_partkey % 2 = 0 THEN 'POLYGON' END AS single, 27700 AS srid,
  CASE WHEN p_partkey % 2 = 0 THEN -p_size ELSE -2 * p_size END::DOUBLE AS turned FROM part
""")
def geometry_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single to multi and back (two parts give NULL), an SRID label, and reversed rings by signed area."""
    k, s, z = F.col("p_partkey"), F.col("p_size").cast("double"), F.lit(0.0)
    part = lambda x: F.array(_ring((x, z), (x + s, z), (x + s, z + 1), (x, z + 1)))
    g = G.make_geom("MULTIPOLYGON", F.when(k % 2 == 0, F.array(part(z))).otherwise(F.array(part(z), part(z + 100))))
    p = read(spark, sf_dir, "part", "p_partkey", "p_size").select(k.alias("k"), G.assign_srid(g, 27700).alias("g"))
    p = p.withColumns({"single": G.force_geometry_type("g", "POLYGON"), "r": G.st_reverse("g")})
    signed = F.aggregate(F.transform(F.col("r")["parts"], lambda part: G.ring_signed_area(part[0])), F.lit(0.0), lambda a, b: a + b)
    return p.select("k", G.force_geometry_type("g", "MULTIPOLYGON")["type"].alias("multi"), F.col("single")["type"].alias("single"),
                    F.col("g")["srid"].alias("srid"), F.round(signed, 6).alias("turned"))


@query("feature_ids", """
SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS fid, p_partkey AS k,
  'POLYGON Z ((0 0 1,' || p_size || ' 0 1,' || p_size || ' 2 5,0 2 5,0 0 1))' AS box FROM part
""")
def feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed geometry with ordinal feature ids; the box of a sloping face."""
    s, z = F.col("p_size").cast("double"), F.lit(0.0)
    face = F.array(F.array(F.array(G.vertex(z, z, F.lit(1.0)), G.vertex(s, z, F.lit(2.0)), G.vertex(s, z + 2, F.lit(5.0)), G.vertex(z, z, F.lit(1.0)))))
    rows = read(spark, sf_dir, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("k"), "p_size", G.make_geom("POLYGON", face).alias("wkb_geometry"))
    named = tabular.name_geometry(rows, "wkb_geometry", "geom", "fid", ["p_size", "k"])
    return named.select(F.col("fid").cast("long").alias("fid"), "k", G.st_astext(G.st_envelope("geom")).alias("box"))


@query("crs_registry", """
SELECT c_custkey::INT AS srid, 'OWN' AS auth_name, 'local ' || c_custkey AS srtext FROM customer
UNION ALL SELECT (1000000 + s_suppkey)::INT, 'EXT', 'grid of ' || s_name FROM supplier
""")
def crs_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom reference systems appended to the registry, none of whose codes is taken."""
    known = read(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").cast("int").alias("srid"), F.lit("OWN").alias("auth_name"),
                                                                F.concat(F.lit("local "), F.col("c_custkey").cast("string")).alias("srtext"))
    new = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).cast("int").alias("srid"), F.lit("EXT").alias("auth_name"),
                                                 F.concat(F.lit("grid of "), "s_name").alias("srtext"))
    return tabular.register_crs(known, new)


@query("osm_file", """
SELECT c_custkey AS way_id, count(*) AS n_nodes, min(lat) AS south, max(v) AS name FROM (
  SELECT c_custkey, unnest([c_custkey, c_custkey + 1, c_custkey + 2]) / 8 AS lat, 'way & ' || c_custkey AS v FROM customer
  WHERE c_custkey + 2 <= (SELECT max(c_custkey) FROM customer)) GROUP BY c_custkey
""")
def osm_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and ways written as OSM XML and read back; ways of three nodes in order."""
    path, k = scratch(spark, "osm"), F.col("c_custkey")
    c = read(spark, sf_dir, "customer", "c_custkey")
    tag = lambda key, value: F.array(F.struct(F.lit(key).alias("_k"), value.alias("_v"))).alias("tag")
    shapes = {"node": [k.alias("_id"), (k / 8).alias("_lat"), F.lit(1.5).alias("_lon"), tag("n", F.lit("x"))],
              "way": [k.alias("_id"), F.transform(F.array(k, k + 1, k + 2), lambda n: F.struct(n.alias("_ref"))).alias("nd"),
                      tag("name", F.concat(F.lit("way & "), k.cast("string")))]}
    for name, columns in shapes.items():
        c.select(*columns).write.format("xml").option("rootTag", "osm").option("rowTag", name).save(f"{path}/{name}")
    nodes, ways, way_nodes = osm.read_osm(spark, f"{path}/*")
    seen = way_nodes.join(nodes, "node_id").groupBy("way_id").agg(F.count("*").alias("n_nodes"), F.min("lat").alias("south"))
    return (seen.where("n_nodes = 3").join(ways, "way_id").select("way_id", "n_nodes", "south", F.col("tags")[0]["_v"].alias("name")))


@query("snapshot_lineage", """
SELECT c_custkey AS id, 'v2' AS version FROM customer WHERE c_nationkey = 3
""")
def snapshot_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineage exported, one exported again; its own previous rows are what a re-import sees."""
    path = scratch(spark, "snapshots")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("lineage"))
    rows.withColumn("version", F.lit("v1")).write.partitionBy("lineage").parquet(path)
    tabular.write_snapshot(rows.withColumn("version", F.lit("v2")), path, "n3")
    return tabular.read_previous(spark, path, "n3").select("id", "version")


@query("geojson_lines", """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'POINT' ELSE 'POLYGON' END AS kind,
  CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 2 * s_suppkey END::DOUBLE AS area FROM supplier
""")
def geojson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features one a line, points and polygons, with typed properties."""
    path, k = scratch(spark, "geojson"), F.col("s_suppkey")
    shape = F.when(k % 2 == 0, F.format_string('{"type":"Point","coordinates":[%d,1]}', k)).otherwise(
        F.format_string('{"type":"Polygon","coordinates":[[[0,0],[%d,0],[%d,2],[0,2],[0,0]]]}', k, k))
    line = F.concat(F.format_string('{"type":"Feature","properties":{"id":%d},"geometry":', k), shape, F.lit("}"))
    read(spark, sf_dir, "supplier", "s_suppkey").select(line.alias("value")).write.text(path)
    f = features.read_features(spark, path, "id long", lines=True)
    return f.select("id", F.col("geom")["type"].alias("kind"), F.when(F.col("geom")["type"] == "POINT", 0.0).otherwise(F.round(G.st_area("geom"), 6)).alias("area"))


@query("geojson_collection", """
SELECT doc_id AS id, sha256(text) AS note_sha256, CASE doc_id % 3 WHEN 2 THEN 2 ELSE 1 END AS n_members,
  CASE doc_id % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'POLYGON' ELSE 'POINT POLYGON' END AS kinds,
  CASE doc_id % 3 WHEN 0 THEN 0 ELSE 2 * (doc_id % 100 + 1) END::DOUBLE AS area FROM documents
""")
def geojson_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as properties of features in collection files that several tasks read, with GeometryCollections."""
    path, k = scratch(spark, "collections"), F.col("doc_id")
    w = k % 100 + 1
    point = F.format_string('{"type":"Point","coordinates":[%d,1]}', w)
    area = F.format_string('{"type":"Polygon","coordinates":[[[0,0],[%d,0],[%d,2],[0,2],[0,0]]]}', w, w)
    shape = F.when(k % 3 == 0, point).when(k % 3 == 1, area).otherwise(
        F.concat(F.lit('{"type":"GeometryCollection","geometries":['), point, F.lit(","), area, F.lit("]}")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(k.alias("id"), F.col("text").alias("note"))),
                       F.lit(',"geometry":'), shape, F.lit("}"))
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select(F.floor(k / 20000).alias("part"), F.lit(1).alias("place"), feature.alias("value"))
    # every file opens with an object beside its features and closes with one, so that each feature ends in a comma
    ends = docs.select("part").distinct().select("part", F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.lit('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"{a}"}},"features":[').alias("value")),
        F.struct(F.lit(2).alias("place"), F.lit('{"type":"End"}]}').alias("value")))).alias("e")).select("part", "e.*")
    lines = docs.withColumn("value", F.concat("value", F.lit(","))).unionByName(ends)
    lines.repartition("part").sortWithinPartitions("part", "place").select("part", "value").write.partitionBy("part").text(path)
    f = features.read_collections(spark, path, "id long, note string")
    return f.select("id", F.sha2("note", 256).alias("note_sha256"), F.size("members").alias("n_members"),
                    F.array_join(F.col("members.type"), " ").alias("kinds"),
                    F.aggregate("members", F.lit(0.0), lambda a, g: a + F.when(g["type"] == "POINT", 0.0).otherwise(F.round(G.st_area(g), 6))).alias("area"))


@query("tbox_table", f"""
SELECT '{EX}Part' || p_partkey AS s, '{T.RDF_TYPE}' AS p, '{T.OWL}Class' AS o FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT '{EX}Part' || p_partkey, '{T.RDFS}subClassOf', '{EX}Size' || p_size FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT '{EX}Part' || p_partkey, '{T.RDF_TYPE}', '{T.OWL}DatatypeProperty' FROM part WHERE p_partkey % 3 = 2
UNION ALL SELECT '{EX}Part' || p_partkey, '{T.RDFS}domain', '{EX}Size' || p_size FROM part WHERE p_partkey % 3 = 2
UNION ALL SELECT '{EX}Part' || p_partkey, '{T.RDFS}range', '{T.XSD}double' FROM part WHERE p_partkey % 3 = 2
""")
def tbox_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition table of classes, subclasses and data properties to ontology triples."""
    k, size = F.col("p_partkey"), F.concat(F.lit("Size"), F.col("p_size").cast("string"))
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "part", "p_partkey", "p_size").select(
        F.concat(F.lit("Part"), k.cast("string")).alias("source"), F.when(k % 3 < 2, F.lit("Class")).otherwise(F.lit("Data Property")).alias("type"),
        F.when(k % 3 == 0, size).alias("target"), F.when(k % 3 == 0, F.lit("IS-A")).alias("relation"), F.when(k % 3 == 2, size).alias("domain"),
        F.when(k % 3 == 2, F.lit("double")).alias("range"), none.alias("comment"))
    return tbox.tbox_to_triples(rows, EX).select("s", "p", "o")


@query("lod_preference", """
SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_partkey WHEN p_partkey % 3 = 0 THEN -p_size WHEN p_partkey % 5 = 0 THEN 7 END::BIGINT AS id FROM part
""")
def lod_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest level of detail that a surface has, with gaps at every level."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part", "p_partkey", "p_size").select(
        k.alias("k"), F.when(k % 5 == 0, F.lit(7)).cast("long").alias("lod2_multi_surface_id"), F.when(k % 2 == 0, k).cast("long").alias("lod4_multi_surface_id"),
        F.when(k % 3 == 0, -F.col("p_size")).cast("long").alias("lod3_multi_surface_id"))
    return rows.select("k", city.prefer_lod(rows, city.SURFACE_LOD_KEYS).alias("id"))


@query("fill_missing", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'own' ELSE c_name END AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that orders lack are filled from their customers; own ones stay."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("own")).alias("label"))
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("c"), "c_name")
    return relational.fill_from(o, c, "c", "label", "c_name").select("k", "label")


@query("raw_city_tables", """
SELECT 'building' AS kind, count(*) AS n FROM part WHERE p_size > 10 UNION ALL SELECT 'surface', 6 * count(*) FROM part WHERE p_size > 10
""")
def raw_city_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preprocessing hook that must give raw buildings and raw surfaces."""
    s, z = F.col("p_size").cast("double"), F.lit(0.0)

    def hook(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        b = city.to_raw_buildings(df, {"id": "p_partkey", "footprint": "fp", "height": "h"})
        return b, city.to_raw_surfaces(b)

    rows = read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", G.box(z, z, s, s).alias("fp"), F.when(s > 10, s).alias("h"))
    buildings, surfaces = hooks.preprocess(rows, hook)
    return (buildings.agg(F.lit("building").alias("kind"), F.count("*").alias("n"))
            .unionByName(surfaces.agg(F.lit("surface").alias("kind"), F.count("*").alias("n"))))
