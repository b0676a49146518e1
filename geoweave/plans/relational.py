"""Relational queries (P*, J*, A*, U*, X*) on the driver tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import pgcompat as pg
from geoweave.operators import relational as R
from geoweave.plans.fixed import CROP_COLOURS, CROP_LABELS, LINE_STYLING, VOLTAGE_BANDS, sql_values
from geoweave.plans.registry import query
from geoweave.plans.tables import read

STYLE_COLS = ["voltage_level", "line_colour", "outline_colour", "line_width", "outline_width", "pylon_icon", "icon_size"]


def crop_lookups(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    labels = spark.createDataFrame(CROP_LABELS, "lucode string, label string")
    colours = spark.createDataFrame(CROP_COLOURS, "lucode string, colour string")
    return labels, colours


def part_lucode(col="p_size"):
    """Stand-in land-use code per part: ``'AC' || lpad(p_size % 21, 2, '0')``."""
    return F.concat(F.lit("AC"), F.lpad((F.col(col) % 21).cast("string"), 2, "0"))


LUCODE_SQL = "'AC' || lpad(CAST(p_size % 21 AS VARCHAR), 2, '0')"


def style_join_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact ⋈ labels ⋈ colours (inner: codes missing from either lookup vanish, T4)."""
    labels, colours = crop_lookups(spark)
    cells = read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", part_lucode().alias("lucode"))
    # Lookups are driver-side literals of known size → broadcasting them is bounded by construction.
    out = cells.join(F.broadcast(labels), "lucode").join(F.broadcast(colours), "lucode")
    icon = F.concat(F.lower(F.replace(F.trim("label"), F.lit(" "), F.lit("_"))), F.lit(".png"))
    return out.select("p_partkey", "lucode", "label", "colour", icon.alias("icon"))


@query("style_join", f"""
SELECT p_partkey, c.lucode, label, colour, lower(replace(trim(label), ' ', '_')) || '.png' AS icon
FROM (SELECT p_partkey, {LUCODE_SQL} AS lucode FROM part) c,
     {sql_values(CROP_LABELS, ['lucode', 'label']).replace(' AS t(', ' AS l(')},
     {sql_values(CROP_COLOURS, ['lucode', 'colour']).replace(' AS t(', ' AS k(')}
WHERE c.lucode = l.lucode AND c.lucode = k.lucode
""")
def style_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_join_df(spark, sf_dir)


@query("voltage_bands", f"""
WITH lines AS (
  SELECT p_partkey, CAST((p_partkey * 7) % 260 - 5 AS VARCHAR) AS operating FROM part),
typed AS (
  SELECT p_partkey, TRY_CAST(operating AS INTEGER) AS voltage FROM lines),
levelled AS (
  SELECT p_partkey, voltage,
         CASE WHEN voltage >= 230 THEN 'S' WHEN voltage >= 35 THEN 'H' WHEN voltage >= 1 THEN 'M' END AS voltage_level
  FROM typed)
SELECT p_partkey, voltage, s.voltage_level, line_colour, line_width, pylon_icon || '.png' AS icon
FROM levelled, {sql_values(LINE_STYLING, STYLE_COLS).replace(' AS t(', ' AS s(')}
WHERE levelled.voltage_level = s.voltage_level
""")
def voltage_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text volts → INT → band; NULL/<1 levels vanish in the styling join (T5)."""
    styling = spark.createDataFrame(LINE_STYLING, ", ".join(f"{c} string" for c in STYLE_COLS))
    lines = read(spark, sf_dir, "part", "p_partkey", "p_size").select(
        "p_partkey", ((F.col("p_partkey") * 7) % 260 - 5).cast("string").alias("operating"))
    lines = R.ensure_column(lines, "voltage", pg.to_int("operating"))
    lines = R.ensure_column(lines, "voltage_level", R.classify_bands("voltage", VOLTAGE_BANDS))
    out = lines.join(F.broadcast(styling), "voltage_level")
    return out.select("p_partkey", "voltage", "voltage_level", "line_colour", "line_width",
                      F.concat("pylon_icon", F.lit(".png")).alias("icon"))


@query("default_and_fallback", """
WITH urgent AS (
  SELECT o_custkey, max(o_totalprice) AS max_price, min(o_orderstatus) AS first_status, count(*) AS n
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' GROUP BY o_custkey)
SELECT c_custkey, COALESCE(max_price, 100.0) AS top_price,
       CASE WHEN first_status IS NOT NULL THEN first_status ELSE c_mktsegment END AS tag,
       COALESCE(n, 0) AS n_urgent
FROM customer LEFT JOIN urgent ON c_custkey = o_custkey
""")
def default_and_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join to a pre-aggregated side (partial aggregation before the shuffle)."""
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    urgent = (orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"))
              .groupBy("o_custkey").agg(F.max("o_totalprice").alias("max_price"),
                                        F.min("o_orderstatus").alias("first_status"),
                                        F.count(F.lit(1)).alias("n")))
    cust = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    j = cust.join(urgent, cust["c_custkey"] == urgent["o_custkey"], "left")
    return j.select("c_custkey", R.with_default("max_price", 100.0).alias("top_price"),
                    R.first_non_null("first_status", "c_mktsegment").alias("tag"),
                    R.with_default("n", 0).cast("bigint").alias("n_urgent"))


@query("pg_strings", """
SELECT s_suppkey,
       substring(s_name, 0, 5) AS short_name,
       ltrim(split_part(s_name, '#', 2), '0') AS num,
       concat(s_name, CASE WHEN s_acctbal < 0 THEN NULL ELSE '+' END, '/', CAST(s_nationkey AS VARCHAR)) AS joined,
       replace(replace(s_name || ' / ' || CAST(s_nationkey AS VARCHAR), ' ', '%20'), '/', '%2F') AS enc,
       url_encode(s_name || ' x*~') AS iri_part
FROM supplier
""")
def pg_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X5 with PostgreSQL semantics (T1 SUBSTRING(…,0,5) = 4 chars, T2 NULL-ignoring CONCAT, T3 encoding)."""
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return s.select(
        "s_suppkey",
        pg.pg_substring("s_name", 0, 5).alias("short_name"),
        pg.trim_leading(pg.split_part("s_name", "#", 2), "0").alias("num"),
        pg.pg_concat("s_name", F.when(F.col("s_acctbal") >= 0, F.lit("+")), F.lit("/"), "s_nationkey").alias("joined"),
        pg.replace_chain(F.concat("s_name", F.lit(" / "), F.col("s_nationkey").cast("string")),
                         [(" ", "%20"), ("/", "%2F")]).alias("enc"),
        pg.iri_encode(F.concat("s_name", F.lit(" x*~"))).alias("iri_part"),
    )


@query("json_path", """
SELECT event_id, json_extract_string(props, '$.k') AS k_text,
       TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events
""")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON path on a text column, then a non-throwing cast."""
    e = read(spark, sf_dir, "events", "event_id", "props")
    kt = pg.json_path_text("props", "$.k")
    return e.select("event_id", kt.alias("k_text"), pg.to_int(kt).alias("k"))


PARTS_SQL = """
WITH parts AS (
  SELECT l_orderkey * 10 + l_linenumber AS id,
         CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + 1 END AS rel,
         CASE WHEN l_quantity > 25 THEN l_quantity END AS height
  FROM lineitem),
kept AS (
  SELECT * FROM parts
  WHERE rel IS NOT NULL OR height IS NOT NULL OR id IN (SELECT rel FROM parts WHERE rel IS NOT NULL))
SELECT CASE WHEN rel IS NOT NULL THEN rel ELSE id END AS parent,
       round(avg(height), 6) AS avg_height, count(*) AS n_parts
FROM kept GROUP BY 1 HAVING avg(height) IS NOT NULL
"""


@query("parts_average", PARTS_SQL)
def parts_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building-part merge semantics on line items (parent = first line of an order)."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    parts = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                      F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") * 10 + 1).alias("rel"),
                      F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("height"))
    kept = R.keep_related(parts, "id", "rel", "height")
    kept = kept.withColumn("parent", R.first_non_null("rel", "id"))
    out = kept.groupBy("parent").agg(F.avg("height").alias("avg_height"), F.count(F.lit(1)).alias("n_parts"))
    return out.where(F.col("avg_height").isNotNull()).withColumn("avg_height", F.round("avg_height", 6))


@query("anti_precise", """
SELECT o_orderkey, o_orderstatus FROM (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS k FROM orders) o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.k AND l.l_returnflag = 'R')
""")
def anti_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT EXISTS; rows with a NULL correlation key are kept."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumn(
        "k", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")))
    returned = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where(F.col("l_returnflag") == "R")
    return o.join(returned, o["k"] == returned["l_orderkey"], "left_anti").select("o_orderkey", "o_orderstatus")


@query("semi_known", """
SELECT o_orderkey, o_orderstatus FROM (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS k FROM orders) o
WHERE k IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def semi_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN (SELECT …); NULL keys never qualify (the other half of T6)."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumn(
        "k", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")))
    returned = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where(F.col("l_returnflag") == "R")
    return o.join(returned, o["k"] == returned["l_orderkey"], "left_semi").select("o_orderkey", "o_orderstatus")


@query("union_tagged", """
SELECT DISTINCT o_custkey, tag FROM (
  SELECT o_custkey, 'finished' AS tag FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT o_custkey, 'open' AS tag FROM orders WHERE o_orderstatus = 'O')
""")
def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION ALL of two sources with a constant tag, then DISTINCT."""
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    parts = {"finished": o.where(F.col("o_orderstatus") == "F").select("o_custkey"),
             "open": o.where(F.col("o_orderstatus") == "O").select("o_custkey")}
    return R.union_tagged(parts).distinct()


def event_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic-attribute (EAV) rows derived from events: uuid always, iri when value > 10 (twice for errors)."""
    e = read(spark, sf_dir, "events", "event_id", "event_type", "value")
    uuid = e.select(F.col("event_id").alias("cityobject_id"), F.lit("uuid").alias("attrname"),
                    pg.stable_uuid("event_id").alias("strval"))
    iri = e.where(F.col("value") > 10).select(
        F.col("event_id").alias("cityobject_id"), F.lit("iri").alias("attrname"),
        F.concat(F.lit("https://example.org/kg/event/"), F.col("event_id").cast("string")).alias("strval"))
    dup = e.where((F.col("value") > 10) & (F.col("event_type") == "error")).select(
        F.col("event_id").alias("cityobject_id"), F.lit("iri").alias("attrname"),
        F.concat(F.lit("https://example.org/kg/event/"), F.col("event_id").cast("string"), F.lit("/alt")).alias("strval"))
    return uuid.unionByName(iri).unionByName(dup)


UUID_SQL = ("substr(sha1(CAST({c} AS VARCHAR)), 1, 8) || '-' || substr(sha1(CAST({c} AS VARCHAR)), 9, 4) || '-' || "
            "substr(sha1(CAST({c} AS VARCHAR)), 13, 4) || '-' || substr(sha1(CAST({c} AS VARCHAR)), 17, 4) || '-' || "
            "substr(sha1(CAST({c} AS VARCHAR)), 21, 12)")

EVENT_ATTRS_SQL = f"""
SELECT event_id AS cityobject_id, 'uuid' AS attrname, {UUID_SQL.format(c='event_id')} AS strval FROM events
UNION ALL
SELECT event_id, 'iri', 'https://example.org/kg/event/' || CAST(event_id AS VARCHAR) FROM events WHERE value > 10
UNION ALL
SELECT event_id, 'iri', 'https://example.org/kg/event/' || CAST(event_id AS VARCHAR) || '/alt'
FROM events WHERE value > 10 AND event_type = 'error'
"""


@query("eav_attach", f"""
WITH a AS ({EVENT_ATTRS_SQL})
SELECT e.event_id, u.strval AS uuid, i.strval AS iri
FROM events e
JOIN a u ON u.cityobject_id = e.event_id AND u.attrname = 'uuid'
JOIN a i ON i.cityobject_id = e.event_id AND i.attrname = 'iri'
""")
def eav_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic attributes attached by one inner join each (missing → gone, duplicates multiply)."""
    objs = read(spark, sf_dir, "events", "event_id")
    out = R.eav_attach(objs, event_attrs(spark, sf_dir), ["uuid", "iri"], obj_id="event_id")
    return out.select("event_id", "uuid", "iri")


@query("bridge_value", """
WITH attrs AS (SELECT event_id, 'osgb' || json_extract_string(props, '$.k') AS strval FROM events),
     bridge AS (SELECT p_partkey AS identifier_1, 'osgb' || CAST(p_partkey AS VARCHAR) AS identifier_2 FROM part)
SELECT event_id, p_partkey, p_name
FROM attrs JOIN bridge ON strval = identifier_2 JOIN part ON identifier_1 = p_partkey
""")
def bridge_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join through an attribute value (``strval = IDENTIFIER_2``) to a second key space."""
    attrs = read(spark, sf_dir, "events", "event_id", "props").select(
        "event_id", F.concat(F.lit("osgb"), pg.json_path_text("props", "$.k")).alias("strval"))
    part = read(spark, sf_dir, "part", "p_partkey", "p_name")
    bridge = part.select(F.col("p_partkey").alias("identifier_1"),
                         F.concat(F.lit("osgb"), F.col("p_partkey").cast("string")).alias("identifier_2"))
    out = R.bridge_join(attrs, bridge, "strval", "identifier_2", "identifier_1", part, "p_partkey")
    return out.select("event_id", "p_partkey", "p_name")


@query("merge_mappings_last_wins", """
SELECT o_custkey AS mapping_id, max(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS definition
FROM orders GROUP BY o_custkey
""")
def merge_mappings_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per id the definition with the highest sequence wins (max_by: partial aggregation)."""
    from geoweave.operators.mapping import merge_mappings

    v = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority").select(
        F.col("o_custkey").alias("mapping_id"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("definition"))
    return merge_mappings(v, "mapping_id", "seq")


@query("ordinal_ids", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders
""")
def ordinal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SERIAL-style ordinal without a single-partition window (range partitions + offsets)."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return R.with_ordinal(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("ordinal").cast("bigint").alias("ordinal"))


# Attribute-equality style rules (property, value, fill) in the shape of an SLD rule list.
STYLE_RULES = [("p_type", "SMALL", "#ba8591"), ("p_type", "LARGE", "#945200"), ("p_brand", "Brand#1", "#375623")]


@query("style_rules", f"""
SELECT p_partkey, 'p_type' AS rule_property, fill FROM part
JOIN {sql_values([r for r in STYLE_RULES if r[0] == 'p_type'], ['property', 'value', 'fill'])} ON p_type = t.value
UNION ALL
SELECT p_partkey, 'p_brand', fill FROM part
JOIN {sql_values([r for r in STYLE_RULES if r[0] == 'p_brand'], ['property', 'value', 'fill'])} ON p_brand = t.value
""")
def style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output row per matching attribute-equality rule (rules table joined per property)."""
    from geoweave.operators.styles import apply_style_rules

    rules = spark.createDataFrame(STYLE_RULES, "property string, value string, fill string")
    part = read(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand")
    return apply_style_rules(part, rules).select("p_partkey", "rule_property", "fill")
