"""Small queries for operators that the larger ones do not touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import geom as G
from geoweave.functions import pgcompat as pg
from geoweave.functions import terms as T
from geoweave.operators import catalog as C
from geoweave.operators import graph as Q
from geoweave.operators import mapping as M
from geoweave.operators import relational as R
from geoweave.operators.hooks import apply_lenses, param_view, post_load, register_view
from geoweave.operators.styles import dynamic_style
from geoweave.plans.catalog import EMPTY_QUADS, NOW1
from geoweave.plans.kg import EX, PFX
from geoweave.plans.registry import query
from geoweave.plans.tables import read

NONE = "NULL::VARCHAR"


@query("ordinal_carried", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_returnflag) AS ordinal, l_orderkey, l_linenumber, l_shipdate, l_returnflag FROM lineitem
""")
def ordinal_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SERIAL ids over shuffled rows that carry other columns."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    return R.with_ordinal(li, ["l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"])


@query("take_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def take_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIMIT under an explicit order."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").withColumn("_down", -F.col("o_totalprice"))
    return R.take(o, 25, ["_down", "o_orderkey"]).drop("_down")


def _labels(df: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    return M.map_triples(df, [(T.iri(f"ex:{kind}/{{{key}}}", PFX), "rdfs:label", T.literal(f"{{{name}}}"))], prefixes=PFX)


@query("federated_labels", f"""
SELECT 'nations' AS g, '{EX}nation/' || n_nationkey AS s, '{T.RDFS}label' AS p, n_name AS o, 'literal' AS o_kind, {NONE} AS o_dtype, {NONE} AS o_lang FROM nation
UNION ALL
SELECT 'regions', '{EX}region/' || r_regionkey, '{T.RDFS}label', r_name, 'literal', NULL, NULL FROM region
""")
def federated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view over two datasets, the graph naming the dataset."""
    n = _labels(read(spark, sf_dir, "nation"), "nation", "n_nationkey", "n_name")
    r = _labels(read(spark, sf_dir, "region"), "region", "r_regionkey", "r_name")
    return R.federate({"nations": n, "regions": r})


@query("map_many_sources", f"""
SELECT DISTINCT {NONE} AS g, '{EX}segment/' || c_mktsegment AS s, '{T.RDFS}label' AS p, c_mktsegment AS o, 'literal' AS o_kind, {NONE} AS o_dtype, {NONE} AS o_lang FROM customer
UNION ALL
SELECT NULL, '{EX}brand/' || replace(p_brand, '#', '%23'), '{T.RDFS}label', p_brand, 'literal', NULL, NULL FROM (SELECT DISTINCT p_brand FROM part)
""")
def map_many_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: several sources mapped into one graph with set semantics."""
    label = lambda kind, col: [(T.iri(f"ex:{kind}/{{{col}}}", PFX), T.RDFS + "label", T.literal(f"{{{col}}}"))]
    return M.map_many([(read(spark, sf_dir, "customer", "c_mktsegment"), label("segment", "c_mktsegment")),
                       (read(spark, sf_dir, "part", "p_brand"), label("brand", "p_brand"))])


@query("wkt_triples", f"""
SELECT {NONE} AS g, '{EX}part/' || p_partkey AS s, '{T.GEO}asWKT' AS p,
       '<http://www.opengis.net/def/crs/EPSG/0/4326> POINT(' || CAST(p_size AS VARCHAR) || ' ' || CAST(p_partkey % 90 AS VARCHAR) || ')' AS o,
       'literal' AS o_kind, '{T.GEO}wktLiteral' AS o_dtype, {NONE} AS o_lang FROM part
""")
def wkt_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry as a CRS-prefixed WKT literal triple."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_size")
    wkt = F.concat(F.lit("POINT("), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_partkey") % 90).cast("string"), F.lit(")"))
    return M.map_triples(p, [(T.iri("ex:part/{p_partkey}", PFX), T.GEO + "asWKT", M.spatial_literal(wkt, 4326))])


@query("bound_variables", """
SELECT n_name AS name, upper(n_name) || '!' AS loud FROM nation ORDER BY n_name LIMIT 10
""")
def bound_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3/Q6: BIND and an ordered, limited projection over a pattern in one named graph (Q11)."""
    quads = _labels(read(spark, sf_dir, "nation"), "nation", "n_nationkey", "n_name").withColumn("g", F.lit("n"))
    other = _labels(read(spark, sf_dir, "region"), "region", "r_regionkey", "r_name")
    found = Q.bgp(Q.graph_filter(quads.unionByName(other), "n"), [("?x", "rdfs:label", "?name")], PFX)
    return Q.select(Q.bind(found, "?loud", F.concat(F.upper("name"), F.lit("!"))), ["?name", "?loud"], 10, ["?name"])


@query("lenient_numbers", """
SELECT c_custkey, c_acctbal AS plain, round(c_custkey / 4.0, 2) AS quarter FROM customer
""")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text → number, plain and padded."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    quarter = F.concat(F.lit("  "), F.round(F.col("c_custkey") / 4.0, 2).cast("string"), F.lit(" "))
    return c.select("c_custkey", pg.pg_to_number(F.col("c_acctbal").cast("string")).alias("plain"), pg.pg_to_number(quarter).alias("quarter"))


@query("page_paths", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS u FROM pages),
n AS (SELECT page_id, regexp_extract(u, '[^/]*$') AS name FROM p)
SELECT page_id, name, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS stem,
       regexp_replace(name, '[^A-Za-z0-9_.]', '_', 'g') AS safe FROM n
""")
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path helpers over every page's url."""
    u = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    p = read(spark, sf_dir, "pages", "page_id", "url").select("page_id", u.alias("u"))
    return p.select("page_id", pg.file_name("u").alias("name"), pg.strip_extension("u").alias("stem"), pg.sanitise_filename("u").alias("safe"))


@query("area_and_type", """
SELECT p_partkey, CAST((p_size % 7) * (p_size % 5) AS DOUBLE) AS area FROM part WHERE (p_size % 7) * (p_size % 5) > 6
""")
def area_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of more than some area; points are filtered out by type."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_size")
    z = F.lit(0.0)
    boxes = p.select("p_partkey", G.box(z, z, (F.col("p_size") % 7).cast("double"), (F.col("p_size") % 5).cast("double")).alias("geom"))
    points = p.select("p_partkey", G.point(F.col("p_size").cast("double"), z).alias("geom"))
    area = G.st_area("geom")
    return R.where_area(R.where_geom_type(boxes.unionByName(points), "geom", ["polygon"]), area, 6.0).select("p_partkey", area.alias("area"))


@query("lookup_dims", """
SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def lookup_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact with its lookups."""
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").withColumnRenamed("s_nationkey", "k")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name", F.col("n_regionkey").alias("r"))
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), "r_name")
    return R.lookup_join(R.lookup_join(s, n, on="k"), r, on="r").select("s_suppkey", "n_name", "r_name")


@query("dynamic_icons", """
SELECT p_partkey, lower(p_brand) || '.png' AS icon, p_size * 2 AS width FROM part
""")
def dynamic_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style values computed from columns."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    return dynamic_style(p, icon=F.concat(F.lower("p_brand"), F.lit(".png")), width=F.col("p_size") * 2).select("p_partkey", "icon", "width")


@query("hooks_and_lenses", """
SELECT c_mktsegment, count(*) AS n, CAST(sum(CASE WHEN c_acctbal > 100 THEN 1 ELSE 0 END) AS BIGINT) AS rich FROM customer
WHERE c_acctbal > 0 GROUP BY 1
""")
def hooks_and_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL hook after loading, two lenses on it, and a view with a checked parameter."""
    loaded = post_load(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal"), "select * from loaded where c_acctbal > 0")
    register_view(loaded, "solvent")
    apply_lenses(spark, [{"name": "flagged", "sql": "select *, c_acctbal > 100 as rich from solvent"},
                         {"name": "counted", "sql": "select c_mktsegment, rich::int as rich from flagged"}])
    return param_view(spark, "select c_mktsegment, count(*) as n, sum(case when rich >= :least then 1 else 0 end) as rich from counted group by 1",
                      {"least": 1}, {"least": "[0-9]+"})


@query("references_refreshed", f"""
SELECT '{EX}' AS base, source AS name, 'src0' AS ref FROM (SELECT DISTINCT source FROM documents) WHERE source IN ('src1', 'src2')
""")
def references_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all datasets, then a load in which only two still list one."""
    names = read(spark, sf_dir, "documents", "source").distinct().select(F.col("source").alias("name"))
    q = C.upsert_catalog(spark.createDataFrame([], EMPTY_QUADS), names.withColumn("description", F.lit(None).cast("string")), NOW1, EX)
    every = names.where("name <> 'src0'").withColumn("ref", F.lit("src0"))
    q = C.refresh_references(C.refresh_references(q, every, names), every.where("name in ('src1', 'src2')"), names)
    titles = C.find_catalogs(q).select(F.col("ds").alias("s"), "name")
    links = q.where(F.col("p") == C.REFERENCES).select("s", F.col("o").alias("ds"))
    return (links.join(titles, "s").join(C.find_catalogs(q).select("ds", F.col("name").alias("ref")), "ds")
            .select(F.lit(EX).alias("base"), "name", "ref"))
