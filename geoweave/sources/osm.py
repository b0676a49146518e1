"""OSM XML → nodes / ways / way_nodes (S17), the inputs of the road-network operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "array<struct<_k:string,_v:string>>"
NODE_SCHEMA = f"_id bigint, _lat double, _lon double, tag {TAG}"
WAY_SCHEMA = f"_id bigint, nd array<struct<_ref:bigint>>, tag {TAG}"


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns ``(nodes(node_id, lon, lat, tags), ways(way_id, tags), way_nodes(way_id, pos, node_id))``.

    Explicit schemas keep a single ``<tag>`` an array (inference would make it a struct).
    """
    n = spark.read.format("xml").option("rowTag", "node").schema(NODE_SCHEMA).load(path)
    w = spark.read.format("xml").option("rowTag", "way").schema(WAY_SCHEMA).load(path)
    nodes = n.select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"),
                     F.coalesce("tag", F.array().cast(TAG)).alias("tags"))
    ways = w.select(F.col("_id").alias("way_id"), F.coalesce("tag", F.array().cast(TAG)).alias("tags"))
    way_nodes = w.select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("pos", "nd")).select(
        "way_id", "pos", F.col("nd._ref").alias("node_id"))
    return nodes, ways, way_nodes
