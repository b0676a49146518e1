"""Time series (T-1..T-3): registration metadata, wide ⇄ long, series triples.

*[gap]*: the reference keeps its storage class outside the tree; the long form
``(series_iri, data_iri, time, value)`` and the wide form (one column per data
IRI) below are our definitions of the same content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import terms as T
from geoweave.operators.mapping import map_triples

UNIX_TRS = "http://dbpedia.org/resource/Unix_time"
TS = "https://example.org/timeseries/"
SERIES_SCHEMA = "series_iri string, data_iri string, value_class string, time_class string, srid int"


def init_series(spark: SparkSession, rows: Sequence[tuple]) -> tuple[DataFrame, DataFrame]:
    """T-1: bulk registration ``(series_iri, data_iri, value_class, time_class, srid)`` → (metadata, empty long table)."""
    meta = spark.createDataFrame(list(rows), SERIES_SCHEMA)
    empty = spark.createDataFrame([], "series_iri string, data_iri string, time timestamp, value double")
    return meta, empty


def to_wide(long: DataFrame, index: Sequence[str], key: str, value: str, keys: Sequence[str], agg: str = "sum") -> DataFrame:
    """T-2: long → wide; ``keys`` is passed explicitly so the pivot needs no extra distinct job."""
    return long.groupBy(*index).pivot(key, list(keys)).agg(getattr(F, agg)(value))


def to_long(wide: DataFrame, index: Sequence[str], columns: Sequence[str], key: str = "data_iri",
            value: str = "value") -> DataFrame:
    """T-2: wide → long (``unpivot``), NULL cells dropped."""
    return wide.unpivot(list(index), list(columns), key, value).where(F.col(value).isNotNull())


def series_triples(meta: DataFrame, trs: str | None = None, prefixes=None) -> DataFrame:
    """T-3: series ↔ data IRIs ↔ time reference system (Unix time for Instant series unless overridden)."""
    trs_col = F.lit(trs) if trs else F.when(F.col("time_class").endswith("Instant"), F.lit(UNIX_TRS)).otherwise(
        F.concat(F.col("series_iri"), F.lit("/trs")))
    m = meta.withColumn("_trs", trs_col)
    s = T.col_term(F.col("series_iri"), "iri")
    d = T.col_term(F.col("data_iri"), "iri")
    return map_triples(m, [
        (s, "a", T.const_iri(TS + "TimeSeries")),
        (d, TS + "hasTimeSeries", s),
        (s, TS + "valueClass", T.col_term(F.col("value_class"), "literal")),
        (s, TS + "hasTRS", T.col_term(F.col("_trs"), "iri")),
    ], prefixes=prefixes)
