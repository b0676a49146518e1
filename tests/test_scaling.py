"""What keeps memory and plans bounded: shuffled joins, rows dealt out, tasks by rows, square cells, size estimates of loops."""

import pytest
from tests.conftest import SF_SMALL, rows
from pyspark.sql import functions as F

from geoweave import session
from geoweave.functions import geom as G
from geoweave.operators import city, graph, network, raster, union
from geoweave.plans import geo


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_footprints_are_not_broadcast(spark):
    ids = spark.range(4)
    building = ids.select("id", F.col("id").alias("lod0_footprint_id"), F.lit(3.0).alias("measured_height"))
    faces = ids.select(F.col("id").alias("root_id"), G.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("geometry"))
    attrs = ids.select(F.col("id").alias("cityobject_id"), F.explode(F.array(F.lit("uuid"), F.lit("iri"))).alias("attrname"),
                       F.lit("u").alias("strval"), F.lit("i").alias("urival"))
    layer = city.footprint_layer(building, faces, attrs)
    assert "BroadcastHashJoin" not in _plan(layer) and layer.count() == 4


def test_faces_are_classified_without_a_join(spark):
    box = lambda z: G.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), z)
    faces = spark.createDataFrame([("a", 0.0), ("a", 3.0), ("b", 3.0), (None, 1.0)], "building_gmlid string, z double")
    found = city.discover_surfaces(faces.select("building_gmlid", "z", box(F.col("z")).alias("geom")))
    assert "Join" not in _plan(found)
    assert rows(found, "building_gmlid", "z", "class") == [("a", 0.0, city.GROUND), ("a", 3.0, city.ROOF), ("b", 3.0, city.GROUND)]


def test_parts_are_dealt_out(spark):
    assert geo.boxes(spark, SF_SMALL).rdd.getNumPartitions() >= 8


def test_cells_of_a_long_feature_are_square(spark, monkeypatch):
    seen, cut = [], union.cut_lineage
    monkeypatch.setattr(union, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    x, y = (F.col("id") % 10).cast("double"), F.floor(F.col("id") / 10).cast("double")
    done = union.union_agg(spark.range(1200).select(F.lit("all").alias("k"), G.box(x, y, x + 1.5, y + 1.0).alias("geom")), "k", small=10)
    assert [r.a for r in done.select(G.st_area("geom").alias("a")).collect()] == [pytest.approx(1260.0)]
    (frame,) = [r for df in seen if "w" in df.columns and "x0" in df.columns for r in df.collect()]
    assert frame.h <= 2 * frame.w


def test_size_estimates_of_rounds_stay_small(spark):
    road = spark.range(299).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(1.0).alias("length_m"))
    d = network.shortest_paths(road, spark.createDataFrame([(0,)], "s long"))
    assert d.where("d = node").count() == 300
    assert d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 500


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    ways = spark.range(400).select((F.col("id") % 100).alias("way_id"), F.col("id").alias("pos"), (F.col("id") % 50).alias("node_id"))
    at = spark.range(50).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    assert network.build_ways(ways, at).rdd.getNumPartitions() == 20
    pixels = spark.range(400).select(F.lit("r").alias("raster"), F.lit(1).alias("band"), F.floor(F.col("id") / 20).alias("row"),
                                     (F.col("id") % 20).alias("col"), F.lit(1.0).alias("value"))
    half = raster.warp(pixels, 0.5)
    assert half.rdd.getNumPartitions() == 20 and half.where("value = 1").count() == 100
    quad = [F.lit(x).cast("string").alias(c) for c, x in (("g", None), ("p", "p"), ("o", "o"), ("o_kind", "iri"), ("o_dtype", None), ("o_lang", None))]
    quads = spark.range(400).select(F.col("id").cast("string").alias("s"), *quad).select(*graph.QUAD_COLUMNS)
    assert session.tasks_for(quads) == 20
    none = quads.where("false").withColumn("added", F.lit(True))
    kept = graph.apply_changes(quads, none, session.tasks_for(quads))
    assert kept.rdd.getNumPartitions() == 20 and kept.count() == 400
