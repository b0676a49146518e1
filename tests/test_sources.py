import json

from pyspark.sql import functions as F

from geoweave.functions import geom as G
from geoweave.sources import features, tabular, tbox
from tests.conftest import rows


def test_tabular_bom_and_empty_values(spark, tmp_path):
    p = tmp_path / "colours.csv"
    p.write_bytes("﻿ift_ioa,colour\nFelled,#e5e5e5\nOther,\n".encode("utf-8"))
    df = tabular.read_tabular(spark, str(p))
    assert df.columns == ["ift_ioa", "colour"]
    assert rows(df) == [("Felled", "#e5e5e5"), ("Other", None)]


def test_geojson_features(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": "way/1", "height": "12.5", "@relations": [{"rel": "r9"}]},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]]}},
        {"type": "Feature", "properties": {"id": "way/2", "height": None, "@relations": None},
         "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}
    p = tmp_path / "b.geojson"
    p.write_text(json.dumps(fc))
    df = features.read_features(spark, str(p), "id string, height string, `@relations` array<struct<rel:string>>")
    got = {r["id"]: r for r in df.select("id", F.col("`@relations`")[0]["rel"].alias("rel"),
                                          G.st_area("geom").alias("a"), F.col("geom.type").alias("t")).collect()}
    assert got["way/1"]["a"] == 12.0 and got["way/1"]["rel"] == "r9" and got["way/2"]["t"] == "POINT"
    assert rows(tabular.select_fields(df, "id, height"), "id") == [("way/1",), ("way/2",)]


def test_scan_and_group_files(spark, tmp_path):
    for n in ["a.shp", "a.dbf", "a.shx", "b.geojson", "c.csv", "sub/d.csv"]:
        f = tmp_path / n
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    files = tabular.scan_files(spark, str(tmp_path))
    groups = {r["driver"]: len(r["paths"]) for r in tabular.group_by_driver(files).collect()}
    assert groups == {"ESRI Shapefile": 1, "GeoJSON": 1, "CSV": 2}


def test_from_text_register_crs_snapshot(spark, tmp_path):
    df = tabular.from_text(spark, ["1,a", "2,b"], "csv", "id int, v string")
    assert rows(df) == [(1, "a"), (2, "b")]
    crs = spark.createDataFrame([(27700, "EPSG", 27700, "", "")], "srid int, auth_name string, auth_srid int, srtext string, proj4text string")
    new = spark.createDataFrame([(900913, "X", 1, "", "")], crs.schema)
    assert tabular.register_crs(crs, new).count() == 2
    try:
        tabular.register_crs(crs, crs)
        raise AssertionError("duplicate srid accepted")
    except ValueError:
        pass
    snap = spark.createDataFrame([("g1", "L1"), ("g2", "L2")], "gmlid string, lineage string")
    tabular.write_snapshot(snap, str(tmp_path / "snap"), "L1")
    assert rows(tabular.read_previous(spark, str(tmp_path / "snap"), "L1"), "gmlid") == [("g1",)]


def test_tbox(spark):
    df = spark.createDataFrame([("Building", "Class", "Thing", "IS-A", None, None, "a building"),
                                ("hasHeight", "Data Property", None, None, "Building", "double", None)],
                               "source string, type string, target string, relation string, domain string, range string, comment string")
    t = tbox.tbox_to_triples(df, "http://ex.org/")
    assert t.count() == 6


def test_newline_delimited_features(spark, tmp_path):
    lines = ['{"type":"Feature","properties":{"id":%d},"geometry":{"type":"Point","coordinates":[%d,2]}}' % (k, k) for k in range(3)]
    (tmp_path / "f.geojsonl").write_text("\n".join(lines) + "\n")
    df = features.read_features(spark, str(tmp_path / "f.geojsonl"), "id int", lines=True)
    assert sorted((r.id, r.geom.parts[0][0][0].x) for r in df.collect()) == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_many_files_are_one_scan(spark, tmp_path):
    for k in range(4):
        df = spark.range(k + 1).withColumnRenamed("id", "a")
        (df.withColumn("b", df.a) if k else df).write.parquet(str(tmp_path / f"p{k}"))
    got = tabular.read_files(spark, [str(tmp_path / f"p{k}") for k in range(4)], "parquet")
    assert got.count() == 10 and got.where("b is null").count() == 1
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
