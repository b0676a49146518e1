"""Streaming query: the events table read as a file stream and mapped to triples (oracle: the batch mapping)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweave.functions import terms as T
from geoweave.operators.mapping import map_triples
from geoweave.plans.registry import query
from geoweave.streaming.events import EVENTS_SCHEMA, run_available

EX = "https://example.org/kg/"


def event_templates():
    s = T.iri(EX + "event/{event_id}")
    return [(s, "a", T.iri(EX + "EventType/{event_type}")),
            (s, EX + "byUser", T.iri(EX + "user/{user_id}")),
            (s, EX + "value", T.literal("{value}", T.XSD + "double"))]


STREAM_SQL = f"""
WITH e AS (SELECT DISTINCT ON (event_id) event_id, event_type, user_id, value FROM events)
SELECT NULL::VARCHAR AS g, '{EX}event/' || url_encode(CAST(event_id AS VARCHAR)) AS s, '{T.RDF_TYPE}' AS p,
       '{EX}EventType/' || url_encode(event_type) AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_dtype,
       NULL::VARCHAR AS o_lang FROM e WHERE event_type IS NOT NULL
UNION ALL
SELECT NULL, '{EX}event/' || url_encode(CAST(event_id AS VARCHAR)), '{EX}byUser',
       '{EX}user/' || url_encode(CAST(user_id AS VARCHAR)), 'iri', NULL, NULL FROM e WHERE user_id IS NOT NULL
UNION ALL
SELECT NULL, '{EX}event/' || url_encode(CAST(event_id AS VARCHAR)), '{EX}value', CAST(value AS VARCHAR), 'literal',
       '{T.XSD}double', NULL FROM e WHERE value IS NOT NULL
"""


@query("events_stream_map", STREAM_SQL)
def events_stream_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 on a stream: ``events.parquet`` consumed with ``availableNow``, duplicates by id skipped."""
    return run_available(spark, sf_dir, EVENTS_SCHEMA, lambda s: map_triples(s, event_templates()),
                         "events", file_glob="events.parquet", dedupe_key="event_id")


@query("events_stream_recent", STREAM_SQL)
def events_stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 on a stream in bounded state: known ids are skipped within a watermark of one day."""
    return run_available(spark, sf_dir, EVENTS_SCHEMA.replace("timestamp_ntz", "timestamp"), lambda s: map_triples(s, event_templates()),
                         "events-recent", file_glob="events.parquet", dedupe_key="event_id", within=("ts", "1 day"))
