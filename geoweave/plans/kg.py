"""Knowledge-graph queries: TPC-H tables mapped to triples (K*), graph patterns (Q*), closure."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import terms as T
from geoweave.operators import closure, graph as G, mapping as M
from geoweave.plans.fixed import CROP_COLOURS, CROP_LABELS
from geoweave.plans.registry import QUERIES, query
from geoweave.plans.relational import style_join_df
from geoweave.plans.tables import read
from geoweave.session import ensure_checkpoint_dir
from geoweave.sources import rdf

EX = "https://example.org/kg/"
PFX = {"ex": EX}
XSD_DEC = T.XSD + "decimal"
XSD_DT = T.XSD + "dateTime"
XSD_INT = T.XSD + "int"
QCOLS = "g, s, p, o, o_kind, o_dtype, o_lang"


def money(c: str):
    """Lexical form of a money value (two decimals, no exponent) — identical in Spark and DuckDB."""
    return F.col(c).cast("decimal(15,2)").cast("string")


def dt_lex(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss")


# --- mappings of the driver tables ----------------------------------------------------

def region_templates():
    s = T.iri("ex:region/{r_regionkey}", PFX)
    return [(s, "a", T.const_iri("ex:Region", PFX)),
            (s, "ex:name", T.literal("{r_name}", lang="en"))]


def nation_templates():
    s = T.iri("ex:nation/{n_nationkey}", PFX)
    return [(s, "a", T.const_iri("ex:Nation", PFX)),
            (s, "ex:name", T.literal("{n_name}")),
            (s, "ex:inRegion", T.iri("ex:region/{n_regionkey}", PFX))]


def customer_templates():
    s = T.iri("ex:customer/{c_custkey}", PFX)
    bal = T.when_term(F.col("c_acctbal") > 0, T.col_term(money("c_acctbal"), "literal", XSD_DEC))
    return [(s, "a", T.const_iri("ex:Customer", PFX)),
            (s, "ex:name", T.literal("{c_name}")),
            (s, "ex:inNation", T.iri("ex:nation/{c_nationkey}", PFX)),
            (s, "ex:segment", T.iri("ex:segment/{c_mktsegment}", PFX)),
            (s, "ex:acctbal", bal)]


def order_templates():
    s = T.iri("ex:order/{o_orderkey}", PFX)
    return [(s, "a", T.const_iri("ex:Order", PFX)),
            (s, "ex:hasCustomer", T.iri("ex:customer/{o_custkey}", PFX)),
            (s, "ex:status", T.literal("{o_orderstatus}")),
            (s, "ex:totalPrice", T.col_term(money("o_totalprice"), "literal", XSD_DEC)),
            (s, "ex:orderDate", T.col_term(dt_lex("o_orderdate"), "literal", XSD_DT)),
            (s, "ex:priority", T.iri("ex:priority/{o_orderpriority}", PFX))]


def tpch_quads(spark: SparkSession, sf_dir: str, tables=("region", "nation", "customer", "orders"),
               mode: str = "virtual", graphs: bool = False) -> DataFrame:
    """Lazy quad view over the driver tables (virtual form: branch pruning on ``p``)."""
    spec = {
        "region": (("r_regionkey", "r_name"), region_templates),
        "nation": (("n_nationkey", "n_name", "n_regionkey"), nation_templates),
        "customer": (("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"), customer_templates),
        "orders": (("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
                   order_templates),
    }
    parts = []
    for t in tables:
        cols, tpl = spec[t]
        parts.append(M.map_triples(read(spark, sf_dir, t, *cols), tpl(), graph=(EX + "graph/" + t) if graphs else None,
                                   mode=mode, prefixes=PFX))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- oracle SQL fragments ---------------------------------------------------------------

def _iri_sql(prefix: str, col: str) -> str:
    return f"'{EX}{prefix}/' || url_encode(CAST({col} AS VARCHAR))"


def _q(s, p, o, kind="'iri'", dt="NULL", lang="NULL", g="NULL", src="", where=""):
    w = f" WHERE {where}" if where else ""
    return (f"SELECT CAST({g} AS VARCHAR) AS g, {s} AS s, '{p}' AS p, {o} AS o, {kind} AS o_kind, "
            f"CAST({dt} AS VARCHAR) AS o_dtype, CAST({lang} AS VARCHAR) AS o_lang FROM {src}{w}")


def region_sql(g="NULL"):
    s = _iri_sql("region", "r_regionkey")
    return [_q(s, T.RDF_TYPE, f"'{EX}Region'", g=g, src="region"),
            _q(s, EX + "name", "r_name", "'literal'", lang="'en'", g=g, src="region")]


def nation_sql(g="NULL"):
    s = _iri_sql("nation", "n_nationkey")
    return [_q(s, T.RDF_TYPE, f"'{EX}Nation'", g=g, src="nation"),
            _q(s, EX + "name", "n_name", "'literal'", g=g, src="nation"),
            _q(s, EX + "inRegion", _iri_sql("region", "n_regionkey"), g=g, src="nation")]


def customer_sql(g="NULL"):
    s = _iri_sql("customer", "c_custkey")
    return [_q(s, T.RDF_TYPE, f"'{EX}Customer'", g=g, src="customer"),
            _q(s, EX + "name", "c_name", "'literal'", g=g, src="customer"),
            _q(s, EX + "inNation", _iri_sql("nation", "c_nationkey"), g=g, src="customer"),
            _q(s, EX + "segment", _iri_sql("segment", "c_mktsegment"), g=g, src="customer"),
            _q(s, EX + "acctbal", "CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR)", "'literal'", f"'{XSD_DEC}'",
               g=g, src="customer", where="c_acctbal > 0")]


def order_sql(g="NULL"):
    s = _iri_sql("order", "o_orderkey")
    return [_q(s, T.RDF_TYPE, f"'{EX}Order'", g=g, src="orders"),
            _q(s, EX + "hasCustomer", _iri_sql("customer", "o_custkey"), g=g, src="orders"),
            _q(s, EX + "status", "o_orderstatus", "'literal'", g=g, src="orders"),
            _q(s, EX + "totalPrice", "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR)", "'literal'", f"'{XSD_DEC}'",
               g=g, src="orders"),
            _q(s, EX + "orderDate", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "'literal'", f"'{XSD_DT}'",
               g=g, src="orders"),
            _q(s, EX + "priority", _iri_sql("priority", "o_orderpriority"), g=g, src="orders")]


def union_sql(parts) -> str:
    return "\nUNION ALL\n".join(parts)


QUADS_SQL = union_sql(region_sql() + nation_sql() + customer_sql() + order_sql())


# --- flagship ------------------------------------------------------------------------------

def cell_templates():
    s = T.iri("ex:cropmap/cell/{p_partkey}", PFX)
    return [(s, "a", T.const_iri("geo:Geometry")),
            (s, "ex:hasID", T.literal("{p_partkey}", "xsd:int")),
            (s, "ex:label", T.literal("{label}")),
            (s, "ex:colour", T.literal("{colour}"))]


@query("cropmap_label_counts", f"""
WITH cells AS (
  SELECT p_partkey, 'AC' || lpad(CAST(p_size % 21 AS VARCHAR), 2, '0') AS lucode FROM part),
styled AS (
  SELECT p_partkey, label FROM cells
  JOIN (VALUES {", ".join(f"('{c}', '{lab}')" for c, lab in CROP_LABELS)}) l(lucode, label) USING (lucode)
  JOIN (VALUES {", ".join(f"('{c}')" for c, _ in CROP_COLOURS)}) k(lucode) USING (lucode))
SELECT label, count(*) AS n_cells FROM styled GROUP BY label
""")
def cropmap_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: J1/J6 styling join → K2 mapping (virtual) → Q1 pattern → count per label."""
    styled = style_join_df(spark, sf_dir)
    quads = M.map_triples(styled, cell_templates(), mode="virtual", prefixes=PFX)
    b = G.bgp(quads, [("?c", "a", "geo:Geometry"), ("?c", "ex:label", "?label")], PFX)
    return b.groupBy(F.col("label")).agg(F.count(F.lit(1)).alias("n_cells"))


# --- mapping queries -------------------------------------------------------------------------

@query("map_nations", union_sql(region_sql() + nation_sql()))
def map_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K3/K5: region + nation mappings (language-tagged literal, IRI references)."""
    return tpch_quads(spark, sf_dir, ("region", "nation"), mode="materialise")


@query("map_orders", union_sql(order_sql()))
def map_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 materialised: 6 triples per order in one scan (explode), percent-encoded IRI values."""
    return tpch_quads(spark, sf_dir, ("orders",), mode="materialise")


@query("map_customers_virtual", union_sql(customer_sql()))
def map_customers_virtual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 virtual + K9: union of per-template projections; the balance triple is conditional."""
    return tpch_quads(spark, sf_dir, ("customer",), mode="virtual")


# Rule document in long form: feeds of documents; only English ones are syndicated, under a tidied display label.
_ENGLISH = {"function": "idlab-fn:equal", "parameters": [["idlab-fn:str", "$(lang)"], ["idlab-fn:otherStr", "en"]]}
DOC_RULES = {
    "prefixes": {"kg": "https://example.org/kg/", "dcterms": "http://purl.org/dc/terms/", "xsd": T.XSD, "grel": M.GREL,
                 "idlab-fn": M.IDLAB},
    "mappings": {
        "entry": {
            "s": "kg:entry/$(id)",
            "po": [["a", "kg:Entry"],
                   ["dcterms:extent", "$(n_chars)", "xsd:integer"],
                   ["kg:state", "indexed"],
                   {"p": "kg:inFeed", "o": [{"mapping": "feed", "condition": _ENGLISH}]}],
        },
        "feed": {
            "s": "kg:feed/$(source)",
            "condition": _ENGLISH,
            "po": [{"p": "kg:caption",
                    "o": {"function": "grel:toUpperCase",
                          "parameters": [{"parameter": "grel:valueParameter",
                                          "value": {"function": "grel:string_trim",
                                                    "parameters": [["grel:valueParameter", " $(source) "]]}}]}}],
        },
    },
}


@query("map_conditional", f"""
SELECT NULL::VARCHAR AS g, '{EX}entry/' || url_encode(CAST(doc_id AS VARCHAR)) AS s, '{T.RDF_TYPE}' AS p,
       '{EX}Entry' AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_dtype, NULL::VARCHAR AS o_lang FROM documents
UNION ALL
SELECT NULL, '{EX}entry/' || url_encode(CAST(doc_id AS VARCHAR)), 'http://purl.org/dc/terms/extent', CAST(n_chars AS VARCHAR), 'literal',
       '{T.XSD}integer', NULL FROM documents WHERE n_chars IS NOT NULL
UNION ALL
SELECT NULL, '{EX}entry/' || url_encode(CAST(doc_id AS VARCHAR)), '{EX}state', 'indexed', 'literal', NULL, NULL FROM documents
UNION ALL
SELECT NULL, '{EX}entry/' || url_encode(CAST(doc_id AS VARCHAR)), '{EX}inFeed', '{EX}feed/' || url_encode(source), 'iri', NULL, NULL
FROM documents WHERE lang = 'en' AND source IS NOT NULL
UNION ALL
SELECT NULL, '{EX}feed/' || url_encode(source), '{EX}caption', upper(trim(source)), 'literal', NULL, NULL
FROM documents WHERE lang = 'en' AND source IS NOT NULL
""")
def map_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7/K9/K10/J13 + E1: rule document with conditions, a typed and a constant literal and nested functions."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    return M.map_rules(docs.withColumnRenamed("doc_id", "id"), DOC_RULES)


@query("map_functions", f"""
SELECT NULL::VARCHAR AS g, '{EX}doc/' || CAST(doc_id AS VARCHAR) AS s, '{EX}compactText' AS p,
       regexp_replace(trim(text), '\\s+', '', 'g') AS o, 'literal' AS o_kind, NULL::VARCHAR AS o_dtype,
       NULL::VARCHAR AS o_lang
FROM documents
UNION ALL
SELECT NULL, '{EX}doc/' || CAST(doc_id AS VARCHAR), '{EX}lang', lang, 'literal', NULL, NULL FROM documents
WHERE lang IS NOT NULL
""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function-valued objects over whole document texts (JVM regex, no UDF)."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fn = M.REGISTRY[M.GREL + "string_replace"](
        p_string_find="/\\s+/", p_string_replace="",
        valueParameter=M.REGISTRY[M.GREL + "string_trim"](valueParameter=F.col("text")))
    s = T.iri("ex:doc/{doc_id}", PFX)
    return M.map_triples(docs, [(s, "ex:compactText", T.col_term(fn)), (s, "ex:lang", T.literal("{lang}"))],
                         prefixes=PFX)


@query("canonical_iri", union_sql([
    f"""SELECT NULL::VARCHAR AS g, '{EX}Customer/' || {'{U}'} AS s, p, o, o_kind, o_dtype, o_lang FROM (
    {union_sql(customer_sql())}) q JOIN customer ON q.s = {_iri_sql('customer', 'c_custkey')}"""
]).replace("{U}", "substr(sha1(CAST(c_custkey AS VARCHAR)), 1, 8) || '-' || substr(sha1(CAST(c_custkey AS VARCHAR)), 9, 4) || '-' || substr(sha1(CAST(c_custkey AS VARCHAR)), 13, 4) || '-' || substr(sha1(CAST(c_custkey AS VARCHAR)), 17, 4) || '-' || substr(sha1(CAST(c_custkey AS VARCHAR)), 21, 12)"))
def canonical_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: canonical IRIs (``Customer/{uuid}``) replace the mapped ones in subject/object position."""
    from geoweave.functions.pgcompat import stable_uuid

    cust = read(spark, sf_dir, "customer", "c_custkey")
    canon = cust.select(T.iri("ex:customer/{c_custkey}", PFX).getField("v").alias("iri"),
                        F.concat(F.lit(EX + "Customer/"), stable_uuid("c_custkey")).alias("canonical"))
    return M.canonicalise(tpch_quads(spark, sf_dir, ("customer",), mode="virtual"), canon)


# --- graph patterns ---------------------------------------------------------------------------

@query("bgp_customer_region", """
SELECT r_name, count(*) AS n_customers
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
""")
def bgp_customer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: 4-pattern BGP over the virtual quad view; pattern filters prune mapping branches."""
    quads = tpch_quads(spark, sf_dir, ("region", "nation", "customer"))
    b = G.bgp(quads, [("?c", "a", "ex:Customer"), ("?c", "ex:inNation", "?n"),
                      ("?n", "ex:inRegion", "?r"), ("?r", "ex:name", "?r_name")], PFX)
    return b.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_customers"))


@query("bgp_optional", f"""
SELECT {_iri_sql('customer', 'c_custkey')} AS c,
       CASE WHEN c_acctbal > 0 THEN CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) END AS bal
FROM customer
""")
def bgp_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: OPTIONAL — every customer, balance only where the conditional triple exists."""
    quads = tpch_quads(spark, sf_dir, ("customer",))
    left = G.bgp(quads, [("?c", "a", "ex:Customer")], PFX)
    right = G.bgp(quads, [("?c", "ex:acctbal", "?bal")], PFX)
    return G.optional(left, right).select("c", "bal")


@query("bgp_optional_chain", f"""
WITH v AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) END AS bal FROM customer),
x AS (SELECT {_iri_sql('customer', 'k')} AS c, bal, CASE WHEN k % 3 = 0 THEN bal ELSE 'other' END AS seen FROM v)
SELECT c, coalesce(bal, seen) AS v, bal IS NOT DISTINCT FROM seen OR bal IS NULL AND seen IS NOT NULL AS agreed FROM x
""")
def bgp_optional_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: a second OPTIONAL over a variable that the first may leave unbound: it binds it there and must agree elsewhere."""
    quads = tpch_quads(spark, sf_dir, ("customer",))
    first = G.optional(G.bgp(quads, [("?c", "a", "ex:Customer")], PFX), G.bgp(quads, [("?c", "ex:acctbal", "?v")], PFX))
    first = first.select("c", "v")
    key = F.substring_index("c", "/", -1).cast("long")
    second = first.select("c", F.when(key % 3 == 0, F.col("v")).otherwise(F.lit("other")).alias("v"), F.lit(True).alias("hit")).where("v is not null")
    return G.optional(first, second, maybe=["?v"]).select("c", "v", F.coalesce("hit", F.col("v").isNull()).alias("agreed"))


@query("bgp_path", f"""
SELECT {_iri_sql('order', 'o_orderkey')} AS o, {_iri_sql('nation', 'c_nationkey')} AS n
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def bgp_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: sequence path ``ex:hasCustomer/ex:inNation``."""
    quads = tpch_quads(spark, sf_dir, ("customer", "orders"))
    return G.path(quads, "?o", ["ex:hasCustomer", "ex:inNation"], "?n", PFX).select("o", "n")


@query("bgp_values", f"""
SELECT n_name AS nn, {_iri_sql('region', 'n_regionkey')} AS r FROM nation WHERE n_regionkey IN (1, 3)
""")
def bgp_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: inline VALUES restricting a pattern variable."""
    quads = tpch_quads(spark, sf_dir, ("nation",))
    b = G.bgp(quads, [("?n", "ex:inRegion", "?r"), ("?n", "ex:name", "?nn")], PFX)
    return G.values(b, "?r", ["ex:region/1", "ex:region/3"], PFX).select("nn", "r")


@query("construct_copy", f"""
WITH q AS ({union_sql(region_sql(f"'{EX}graph/region'") + nation_sql(f"'{EX}graph/nation'"))})
SELECT DISTINCT * FROM (
  SELECT * FROM q
  UNION ALL
  SELECT '{EX}graph/copy' AS g, s, p, o, o_kind, o_dtype, o_lang FROM q WHERE g = '{EX}graph/region'
  UNION ALL
  SELECT NULL, s, '{EX}locatedIn', o, o_kind, o_dtype, o_lang FROM q WHERE p = '{EX}inRegion')
""")
def construct_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3 + Q7: copy a named graph into a target graph and CONSTRUCT a renamed relation."""
    from geoweave.operators.relational import copy_graphs

    quads = tpch_quads(spark, sf_dir, ("region", "nation"), graphs=True)
    copied = copy_graphs(quads, [EX + "graph/region"], EX + "graph/copy")
    built = G.construct(G.bgp(quads, [("?n", "ex:inRegion", "?r")], PFX), [("?n", "ex:locatedIn", "?r")], PFX)
    return copied.unionByName(built).distinct()


@query("modify_where", f"""
WITH q AS ({union_sql(order_sql())})
SELECT DISTINCT * FROM (
  SELECT * FROM q WHERE NOT (p = '{EX}status' AND o = 'F' AND o_kind = 'literal' AND o_dtype IS NULL)
  UNION ALL
  SELECT NULL, s, '{T.RDF_TYPE}', '{EX}FinishedOrder', 'iri', NULL, NULL FROM q
  WHERE p = '{EX}status' AND o = 'F' AND o_dtype IS NULL)
""")
def modify_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: DELETE {?o status "F"} INSERT {?o a FinishedOrder} WHERE {?o status "F"}."""
    quads = tpch_quads(spark, sf_dir, ("orders",))
    return G.modify(quads, delete=[("?o", "ex:status", G.Lit("F"))], insert=[("?o", "a", "ex:FinishedOrder")],
                    where=[("?o", "ex:status", G.Lit("F"))], prefixes=PFX)


RULES = [
    {"where": [("?o", "ex:hasCustomer", "?c"), ("?o", "ex:status", "?st")],
     "insert": [("?c", "ex:hasOrderStatus", "?st")]},
    {"where": [("?c", "ex:hasOrderStatus", G.Lit("O"))], "insert": [("?c", "a", "ex:ActiveCustomer")]},
]


@query("rules_in_order", f"""
WITH q AS ({union_sql(customer_sql() + order_sql())}),
r1 AS (
  SELECT * FROM q
  UNION
  SELECT NULL, c.o, '{EX}hasOrderStatus', st.o, st.o_kind, st.o_dtype, st.o_lang
  FROM q c JOIN q st ON c.s = st.s
  WHERE c.p = '{EX}hasCustomer' AND st.p = '{EX}status')
SELECT * FROM r1
UNION
SELECT NULL, s, '{T.RDF_TYPE}', '{EX}ActiveCustomer', 'iri', NULL, NULL FROM r1
WHERE p = '{EX}hasOrderStatus' AND o = 'O' AND o_kind = 'literal' AND o_dtype IS NULL
""")
def rules_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: update rules run once each, in order (rule 2 sees rule 1's output)."""
    quads = tpch_quads(spark, sf_dir, ("customer", "orders"))
    return G.run_rules(quads, RULES, PFX)


# --- RDFS closure ----------------------------------------------------------------------------

def class_tree_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as classes (nation ⊑ region), customers typed by their nation."""
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    cust = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    sc = M.map_triples(nation, [(T.iri("ex:NationClass{n_nationkey}", PFX), "rdfs:subClassOf",
                                 T.iri("ex:RegionClass{n_regionkey}", PFX))], prefixes=PFX)
    ty = M.map_triples(cust, [(T.iri("ex:customer/{c_custkey}", PFX), "a", T.iri("ex:NationClass{c_nationkey}", PFX))],
                       prefixes=PFX)
    return sc.unionByName(ty)


_SC = T.RDFS + "subClassOf"
_CLS = T.RDFS + "Class"
_RES = T.RDFS + "Resource"


@query("rdfs_closure", f"""
WITH classes AS (
  SELECT '{EX}NationClass' || CAST(n_nationkey AS VARCHAR) AS c FROM nation
  UNION SELECT '{EX}RegionClass' || CAST(n_regionkey AS VARCHAR) FROM nation
  UNION SELECT '{EX}NationClass' || CAST(c_nationkey AS VARCHAR) FROM customer),
t AS (
  SELECT '{EX}NationClass' || CAST(n_nationkey AS VARCHAR) AS s, '{_SC}' AS p,
         '{EX}RegionClass' || CAST(n_regionkey AS VARCHAR) AS o FROM nation
  UNION SELECT '{EX}customer/' || CAST(c_custkey AS VARCHAR), '{T.RDF_TYPE}', '{EX}NationClass' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION SELECT '{EX}customer/' || CAST(c_custkey AS VARCHAR), '{T.RDF_TYPE}', '{EX}RegionClass' || CAST(n_regionkey AS VARCHAR)
        FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT c, '{T.RDF_TYPE}', '{_CLS}' FROM classes
  UNION SELECT c, '{_SC}', c FROM classes
  UNION SELECT c, '{_SC}', '{_RES}' FROM classes)
SELECT NULL::VARCHAR AS g, s, p, o, 'iri' AS o_kind, NULL::VARCHAR AS o_dtype, NULL::VARCHAR AS o_lang FROM t
""")
def rdfs_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: RDFS closure — iterative schema closure, one join for instance typing."""
    return closure.rdfs_closure(class_tree_quads(spark, sf_dir))


@query("rdfs_meta", f"""
SELECT '{EX}RegionClass' || CAST(n_regionkey AS VARCHAR) AS o, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
UNION ALL SELECT '{EX}Place', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def rdfs_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: class tree stated by a property that only a further property puts below subClassOf; instances reach the top."""
    tree = class_tree_quads(spark, sf_dir)
    own = tree.withColumn("p", F.when(F.col("p") == _SC, F.lit(EX + "within")).otherwise(F.col("p")))
    tops = own.where(F.col("p") == EX + "within").select(F.col("o").alias("s")).distinct().withColumn("o", F.lit(EX + "Place"))
    rules = spark.createDataFrame([(EX + "within", EX + "narrower", EX + "below"), (EX + "below", T.RDFS + "subPropertyOf", T.RDFS + "subPropertyOf"),
                                   (EX + "narrower", _SC, T.RDFS + "subPropertyOf")],
                                  "s string, o string, p string")
    facts = tops.withColumn("p", F.lit(EX + "narrower")).unionByName(rules.select("s", "o", "p"))
    iri = {"g": F.lit(None).cast("string"), "o_kind": F.lit("iri"), "o_dtype": F.lit(None).cast("string"), "o_lang": F.lit(None).cast("string")}
    closed = closure.rdfs_closure(own.unionByName(facts.withColumns(iri).select(*own.columns)))
    return (closed.where((F.col("p") == T.RDF_TYPE) & F.col("s").startswith(EX + "customer/"))
            .where(F.col("o").startswith(EX + "RegionClass") | (F.col("o") == EX + "Place")).groupBy("o").agg(F.count("*").alias("n")))


@query("nest_json", f"""
SELECT {_iri_sql('customer', 'c_custkey')} AS id,
       to_json({{'id': {_iri_sql('customer', 'c_custkey')}, 'name': [c_name],
                 'balance': CASE WHEN c_acctbal > 0 THEN [CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR)]
                                 ELSE CAST([] AS VARCHAR[]) END}})::VARCHAR AS json
FROM customer
""")
def nest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: nest customer bindings into one JSON document per customer."""
    quads = tpch_quads(spark, sf_dir, ("customer",))
    b = G.optional(G.bgp(quads, [("?c", "a", "ex:Customer"), ("?c", "ex:name", "?name")], PFX),
                   G.bgp(quads, [("?c", "ex:acctbal", "?bal")], PFX))
    return G.shape_json(b, "?c", {"name": {"var": "?name", "required": True}, "balance": {"var": "?bal"}})


# --- dataset references (D1) -------------------------------------------------------------------

@query("reference_closure", """
WITH RECURSIVE e AS (
  SELECT p_partkey AS name, p_partkey * 2 + 1 AS ref FROM part WHERE p_partkey * 2 + 1 IN (SELECT p_partkey FROM part)
  UNION SELECT p_partkey, p_partkey * 2 + 2 FROM part WHERE p_partkey * 2 + 2 IN (SELECT p_partkey FROM part)
  UNION SELECT p_partkey, p_partkey * 3 + 1 FROM part WHERE p_partkey * 3 + 1 IN (SELECT p_partkey FROM part)),
r(name, level) AS (
  SELECT 0::BIGINT, 0
  UNION
  SELECT e.ref, r.level + 1 FROM r JOIN e ON e.name = r.name)
SELECT CAST(name AS VARCHAR) AS name, max(level) AS level FROM r GROUP BY name
""")
def reference_closure_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency closure from dataset "0" over a DAG of part keys (level = max depth)."""
    part = read(spark, sf_dir, "part", "p_partkey")
    names = part.select(F.col("p_partkey").cast("string").alias("name"))
    k = F.col("p_partkey")
    cand = (part.select(k.alias("name"), (k * 2 + 1).alias("ref"))
            .unionByName(part.select(k.alias("name"), (k * 2 + 2).alias("ref")))
            .unionByName(part.select(k.alias("name"), (k * 3 + 1).alias("ref"))))
    edges = cand.join(part.select(F.col("p_partkey").alias("ref")), "ref", "left_semi")
    edges = edges.select(F.col("name").cast("string").alias("name"), F.col("ref").cast("string").alias("ref"))
    out = closure.reference_closure(edges, names, "0")
    return out.select("name", F.col("level").cast("int").alias("level"))


def _stored(spark: SparkSession, sf_dir: str, tables, graphs: bool = False) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quads-{uuid.uuid4().hex}"
    rdf.write_quad_table(tpch_quads(spark, sf_dir, tables, mode="materialise", graphs=graphs), path)
    return path


@query("modify_stored", QUERIES["modify_where"][1])
def modify_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 on a stored quad table: the update of ``modify_where``, which rewrites two predicates of the orders."""
    path = _stored(spark, sf_dir, ("orders",))
    rdf.update_quad_table(spark, path, [("?o", "ex:status", G.Lit("F"))], [("?o", "a", "ex:FinishedOrder")],
                          [("?o", "ex:status", G.Lit("F"))], PFX)
    return rdf.read_quad_table(spark, path)


@query("rules_stored", QUERIES["rules_in_order"][1])
def rules_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 on a stored quad table: rules in order, each rewriting the predicates it inserts into."""
    path = _stored(spark, sf_dir, ("customer", "orders"))
    rdf.run_rules_stored(spark, path, RULES, PFX)
    return rdf.read_quad_table(spark, path)


@query("remove_stored", f"""
WITH q AS ({union_sql(order_sql())}), gone AS (SELECT s FROM q WHERE p = '{EX}status' AND o = 'F')
SELECT DISTINCT * FROM q WHERE s NOT IN (SELECT s FROM gone)
""")
def remove_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9's removal on a stored quad table: every finished order leaves all its predicates."""
    path = _stored(spark, sf_dir, ("orders",))
    finished = G.bgp(rdf.read_quad_table(spark, path), [("?o", "ex:status", G.Lit("F"))], PFX)
    rdf.remove_nodes_stored(spark, path, finished.select("o"))
    return rdf.read_quad_table(spark, path)
