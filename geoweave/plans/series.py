"""Time-series queries on ``events`` (series per user, one data IRI per event type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators import timeseries as TSO
from geoweave.plans.registry import query
from geoweave.plans.tables import read

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EX = "https://example.org/kg/"


def daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_type", "value")
    return e.select("user_id", F.to_date("ts").alias("day"), "event_type", "value")


@query("series_wide", f"""
SELECT user_id, CAST(ts AS DATE) AS day,
       {', '.join(f"round(sum(CASE WHEN event_type = '{t}' THEN value END), 6) AS {t}" for t in EVENT_TYPES)}
FROM events GROUP BY user_id, CAST(ts AS DATE)
""")
def series_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-2: long → wide (one column per event type, explicit pivot values: no extra distinct job)."""
    w = TSO.to_wide(daily_long(spark, sf_dir), ["user_id", "day"], "event_type", "value", EVENT_TYPES)
    return w.select("user_id", "day", *[F.round(t, 6).alias(t) for t in EVENT_TYPES])


@query("series_long", """
SELECT user_id, CAST(ts AS DATE) AS day, event_type, round(sum(value), 6) AS value
FROM events GROUP BY 1, 2, 3
""")
def series_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-2: wide → long (unpivot) round-trip; empty cells dropped."""
    w = TSO.to_wide(daily_long(spark, sf_dir), ["user_id", "day"], "event_type", "value", EVENT_TYPES)
    lg = TSO.to_long(w, ["user_id", "day"], EVENT_TYPES, "event_type", "value")
    return lg.select("user_id", "day", "event_type", F.round("value", 6).alias("value"))


@query("series_triples", f"""
WITH m AS (SELECT DISTINCT '{EX}series/' || CAST(user_id AS VARCHAR) AS series_iri,
                  '{EX}data/' || CAST(user_id AS VARCHAR) || '/' || event_type AS data_iri FROM events)
SELECT DISTINCT * FROM (
  SELECT NULL::VARCHAR AS g, series_iri AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p,
         '{TSO.TS}TimeSeries' AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_dtype, NULL::VARCHAR AS o_lang FROM m
  UNION ALL SELECT NULL, data_iri, '{TSO.TS}hasTimeSeries', series_iri, 'iri', NULL, NULL FROM m
  UNION ALL SELECT NULL, series_iri, '{TSO.TS}valueClass', 'double', 'literal', NULL, NULL FROM m
  UNION ALL SELECT NULL, series_iri, '{TSO.TS}hasTRS', '{TSO.UNIX_TRS}', 'iri', NULL, NULL FROM m)
""")
def series_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1/T-3: series registration rows derived from events, mapped with the Unix-time TRS."""
    e = read(spark, sf_dir, "events", "user_id", "event_type")
    meta = e.select(F.concat(F.lit(EX + "series/"), F.col("user_id").cast("string")).alias("series_iri"),
                    F.concat(F.lit(EX + "data/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("data_iri"),
                    F.lit("double").alias("value_class"), F.lit("Instant").alias("time_class"),
                    F.lit(None).cast("int").alias("srid")).distinct()
    return TSO.series_triples(meta).distinct()
