"""Road-network queries: orders are ways, their line items (in line order) the way's nodes,
parts the nodes (coordinates derived from the part key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators import network as N
from geoweave.operators.relational import with_ordinal
from geoweave.plans.registry import query
from geoweave.plans.tables import read
from geoweave.session import kept

NODE_LON = "(p_partkey % 100) / 100.0"
NODE_LAT = "(51.0 + floor(p_partkey / 100) / 100.0)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_type")
    tag = F.struct(F.lit("amenity").alias("_k"), F.lower("p_type").alias("_v"))
    return p.select(F.col("p_partkey").alias("node_id"), ((F.col("p_partkey") % 100) / 100.0).alias("lon"),
                    (51.0 + F.floor(F.col("p_partkey") / 100) / 100.0).alias("lat"),
                    F.when(F.col("p_size") > 45, F.array(tag)).otherwise(F.array().cast("array<struct<_k:string,_v:string>>"))
                    .alias("tags"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return li.select(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("node_id"))


EDGES_SQL = f"""
WITH wn AS (SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos,
                   l_partkey AS node_id FROM lineitem),
shared AS (SELECT node_id FROM wn GROUP BY node_id HAVING count(*) >= 2),
flag AS (
  SELECT wn.*, (pos = min(pos) OVER (PARTITION BY way_id) OR pos = max(pos) OVER (PARTITION BY way_id)
                OR node_id IN (SELECT node_id FROM shared)) AS is_vertex,
         pos = min(pos) OVER (PARTITION BY way_id) AS is_first, pos = max(pos) OVER (PARTITION BY way_id) AS is_last
  FROM wn),
seg AS (SELECT *, sum(CAST(is_vertex AS INTEGER)) OVER (PARTITION BY way_id ORDER BY pos) AS s FROM flag),
pts AS (
  SELECT way_id, s AS seg, pos, node_id FROM seg WHERE NOT is_last
  UNION ALL
  SELECT way_id, s - 1, pos, node_id FROM seg WHERE is_vertex AND NOT is_first),
geo AS (
  SELECT pts.*, {NODE_LON} AS lon, {NODE_LAT} AS lat FROM pts JOIN part ON node_id = p_partkey),
stepd AS (
  SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM geo WINDOW w AS (PARTITION BY way_id, seg ORDER BY pos)),
d AS (
  SELECT *, CASE WHEN plon IS NULL THEN 0.0 ELSE 2 * 6371008.8 * asin(sqrt(
      power(sin((radians(lat) - radians(plat)) / 2), 2) +
      cos(radians(plat)) * cos(radians(lat)) * power(sin((radians(lon) - radians(plon)) / 2), 2))) END AS dd
  FROM stepd),
e AS (
  SELECT way_id, seg, arg_min(node_id, pos) AS source, arg_max(node_id, pos) AS target, sum(dd) AS length_m,
         count(*) AS n_points,
         'LINESTRING (' || string_agg(CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR), ', ' ORDER BY pos) || ')' AS wkt
  FROM d GROUP BY way_id, seg HAVING count(*) >= 2)
"""


@query("network_build", EDGES_SQL + """
SELECT CAST(way_id AS VARCHAR) || '_' || CAST(seg AS VARCHAR) AS edge_id, way_id, source, target,
       round(length_m, 3) AS length_m, n_points, wkt FROM e
""")
def network_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways split at shared nodes → edges with source, target, haversine length, point count and line."""
    e = N.build_ways(way_nodes(spark, sf_dir), nodes(spark, sf_dir))
    return e.withColumn("length_m", F.round("length_m", 3))


@query("vertex_degree", EDGES_SQL + """
SELECT id, count(*) AS degree, 'POINT (' || CAST(any_value((id % 100) / 100.0) AS VARCHAR) || ' '
       || CAST(any_value(51.0 + floor(id / 100) / 100.0) AS VARCHAR) || ')' AS wkt
FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id
""")
def vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edge ends with degree and position."""
    at = nodes(spark, sf_dir)
    return N.build_vertices(N.build_ways(way_nodes(spark, sf_dir), at), at)


@query("network_costs", EDGES_SQL + """
SELECT CAST(way_id AS VARCHAR) || '_' || CAST(seg AS VARCHAR) AS edge_id,
       CASE WHEN o_orderpriority <> '5-LOW' THEN 101 END AS class_id,
       CASE WHEN o_orderpriority <> '5-LOW' THEN CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN -1 ELSE 2 END END AS one_way,
       round(CASE WHEN o_orderpriority <> '5-LOW' THEN CASE WHEN o_orderstatus = 'P' THEN -1.0 ELSE length_m END END, 3) AS cost,
       round(CASE WHEN o_orderpriority <> '5-LOW' THEN CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE length_m END END, 3) AS reverse_cost,
       round(CASE WHEN o_orderpriority <> '5-LOW' THEN CASE WHEN o_orderstatus = 'P' THEN -1.0 ELSE length_m / (60.0 / 3.6) END END, 3) AS cost_s
FROM e LEFT JOIN orders ON o_orderkey = way_id
""")
def network_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, direction and forward / reverse costs of every edge; unclassified ways have none."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").where("o_orderpriority <> '5-LOW'")
    classes = o.select(F.col("o_orderkey").alias("way_id"), F.lit(101).alias("class_id"), F.lit(60.0).alias("maxspeed_kmh"),
                       F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "P", "-1").alias("oneway"))
    e = N.with_costs(N.build_ways(way_nodes(spark, sf_dir), nodes(spark, sf_dir)), classes)
    return e.select("edge_id", "class_id", "one_way", *[F.round(c, 3).alias(c) for c in ("cost", "reverse_cost", "cost_s")])


@query("network_append", """
WITH a AS (SELECT l_orderkey AS way_id, l_linenumber AS pos, l_partkey AS node_id FROM lineitem WHERE l_orderkey % 3 <> 0),
b AS (SELECT l_orderkey AS way_id, l_linenumber + 10 AS pos, l_partkey AS node_id FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE way_id NOT IN (SELECT way_id FROM a)
""")
def network_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extract adds the ways that the first one lacks, with all their rows."""
    wn = way_nodes(spark, sf_dir)
    return N.append_network(wn.where("way_id % 3 <> 0"), wn.where("way_id % 2 = 0").withColumn("pos", F.col("pos") + 10))


@query("points_of_interest", f"""
SELECT p_partkey AS node_id, {NODE_LON} AS lon, {NODE_LAT} AS lat, lower(p_type) AS amenity FROM part WHERE p_size > 45
""")
def points_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged nodes."""
    poi = N.points_of_interest(nodes(spark, sf_dir), ["amenity"])
    return poi.select("node_id", "lon", "lat", F.col("tags")["amenity"].alias("amenity"))


# Highway class configuration keyed by the stand-in tag value.
HIGHWAY_CONFIG = [("motorway", 101, 120.0), ("trunk", 102, 100.0), ("primary", 103, 80.0), ("residential", 104, 30.0)]
PRIORITY_TAG = {"1-URGENT": "motorway", "2-HIGH": "trunk", "3-MEDIUM": "primary", "4-NOT SPECIFIED": "service",
                "5-LOW": "residential"}


@query("way_filter", f"""
WITH t AS (SELECT o_orderkey AS way_id, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_TAG.items())} END AS value
           FROM orders)
SELECT way_id, value, class_id, CAST(speed AS DOUBLE) AS speed FROM t
JOIN (VALUES {', '.join(f"('{v}', {c}, {s!r})" for v, c, s in HIGHWAY_CONFIG)}) c(value, class_id, speed) USING (value)
""")
def way_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep ways whose highway tag is configured; attach class id and speed."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    mapping = F.create_map(*[F.lit(x) for kv in PRIORITY_TAG.items() for x in kv])
    ways = o.select(F.col("o_orderkey").alias("way_id"), F.array(F.struct(F.lit("highway").alias("_k"),
                                                                           mapping[F.col("o_orderpriority")].alias("_v"))).alias("tags"))
    cfg = spark.createDataFrame(HIGHWAY_CONFIG, "value string, class_id int, speed double")
    return N.osm_filter(ways, cfg).select("way_id", "value", "class_id", "speed")


SHORTEST_SQL = EDGES_SQL.replace("WITH wn AS", "WITH RECURSIVE wn AS", 1) + """,
g AS (SELECT u, v, min(w) AS w FROM (SELECT source AS u, target AS v, length_m AS w FROM e
                                   UNION ALL SELECT target, source, length_m FROM e) GROUP BY u, v),
dist(node, d) USING KEY (node) AS (
  SELECT CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE)
  UNION
  SELECT g.v, min(dist.d + g.w)
  FROM dist JOIN g ON dist.node = g.u
  LEFT JOIN recurring.dist AS old ON old.node = g.v
  GROUP BY g.v, old.d
  HAVING old.d IS NULL OR min(dist.d + g.w) < old.d - 1e-9)
SELECT node, round(d, 3) AS distance_m FROM dist
"""


@query("shortest_paths", SHORTEST_SQL)
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from vertex 0 over the undirected edge graph (iterative relaxation; the oracle is
    a key-replacing recursive CTE, and the tests cross-check against Dijkstra)."""
    e = N.build_ways(way_nodes(spark, sf_dir), nodes(spark, sf_dir))
    src = spark.range(1).select(F.lit(0).cast("bigint").alias("source"))
    d = N.shortest_paths(e, src)
    return d.select("node", F.round("d", 3).alias("distance_m"))


@query("shortest_paths_chain", """
WITH n AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT k AS node, CAST(i AS DOUBLE) AS distance_m FROM n
""")
def shortest_paths_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as the nodes of one road without a junction, one metre apart; log(n) rounds, not n."""
    at = kept(with_ordinal(read(spark, sf_dir, "orders", "o_orderkey"), ["o_orderkey"], "i"))
    after = at.select((F.col("i") - 1).alias("i"), F.col("o_orderkey").alias("target"))
    road = at.select("i", F.col("o_orderkey").alias("source")).join(after, "i").select("source", "target", F.lit(1.0).alias("length_m"))
    first = at.agg(F.min("o_orderkey").alias("source"))
    return N.shortest_paths(road, first).select("node", F.col("d").alias("distance_m"))
