import pytest
from pyspark.sql import functions as F

from geoweave.functions import geom as G
from geoweave.operators import catalog as C, city as CT, hooks as H, network as N
from tests.conftest import rows

EX = "http://ex.org/"
Q = "g string, s string, p string, o string, o_kind string, o_dtype string, o_lang string"


def test_param_view_binds_and_validates(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").createOrReplaceTempView("t_pv")
    df = H.param_view(spark, "SELECT v FROM t_pv WHERE id = :id", {"id": 2}, {"id": r"\d+"})
    assert rows(df) == [("b",)]
    with pytest.raises(ValueError):
        H.param_view(spark, "SELECT v FROM t_pv WHERE id = :id", {"id": "1 OR 1=1"}, {"id": r"\d+"})
    with pytest.raises(ValueError):
        H.param_view(spark, "SELECT v FROM t_pv WHERE id = :id", {})


def test_hooks_and_lenses(spark):
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    assert H.post_load(df, "SELECT id, upper(v) AS v FROM loaded").first()["v"] == "X"
    assert H.post_load(df, lambda d: d.withColumn("w", F.lit(1))).columns == ["id", "v", "w"]
    out = H.apply_lenses(spark, [{"name": "l1", "sql": "SELECT 1 AS a"}, {"name": "l2", "sql": "SELECT a + 1 AS b FROM l1"}])
    assert out["l2"].first()["b"] == 2
    with pytest.raises(ValueError):
        H.preprocess(df, lambda d: (d, d))


def _catalog(spark):
    ds = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "name string, description string")
    return C.upsert_catalog(spark.createDataFrame([], Q), ds, "2024-01-01T00:00:00", EX)


def test_references_metadata_services_drop(spark):
    q = _catalog(spark)
    q = C.refresh_references(q, spark.createDataFrame([("a", "b"), ("a", "c")], "name string, ref string"))
    q = C.refresh_references(q, spark.createDataFrame([("a", "c")], "name string, ref string"))
    assert q.where(F.col("p") == C.REFERENCES).count() == 1
    with pytest.raises(ValueError):
        C.refresh_references(q, spark.createDataFrame([("a", "zzz")], "name string, ref string"))
    q = C.add_metadata(q, ["a"], [("?dataset", f"<{EX}license>", f"<{EX}cc-by>")])
    assert q.where(F.col("p") == EX + "license").count() == 1
    svc = spark.createDataFrame([("a", "graph", "a-graph", EX + "g/a")], "name string, type string, title string, url string")
    q = C.refresh_services(q, svc, EX)
    q = C.refresh_services(q, svc.withColumn("url", F.lit(EX + "g/a2")), EX)
    assert rows(C.service_lookup(q, "a"), "url") == [(EX + "g/a2",)]
    left = C.drop_dataset(spark, q, "a")
    assert rows(C.catalog_table(left), "title") == [("b",), ("c",)]
    assert left.where(F.col("o").contains("g/a2")).count() == 0


def test_append_network_first_wins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "way_id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "way_id long, v string")
    assert rows(N.append_network(a, b)) == [(1, "x"), (2, "y"), (3, "w")]


def test_populate_city_tables_and_footprint(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (2, 20.0, 5.0)], "id long, x double, h double")
    df = df.withColumn("fp", G.box(F.col("x"), F.lit(0.0), F.col("x") + 4.0, F.lit(3.0), srid=27700))
    raw_b = CT.to_raw_buildings(df, {"id": "id", "footprint": "fp", "height": "h"})
    raw_s = CT.to_raw_surfaces(raw_b)
    t = CT.populate_city_tables(raw_b, raw_s, "L1")
    assert t["building"].count() == 2 and t["thematic_surface"].count() == 12
    assert len({r[0] for r in t["cityobject"].select("id").collect()}) == 14
    b2, sg2, fps = CT.add_footprint(t["building"], t["cityobject"], t["thematic_surface"], t["surface_geometry"], 27700)
    assert rows(fps.select("kind", G.st_area("geom"))) == [("precise", 12.0), ("precise", 12.0)]
    assert b2.where(F.col("lod0_footprint_id").isNull()).count() == 0
    layer = CT.footprint_layer(b2, sg2, spark.createDataFrame(
        [(r[0], n, "u", EX + "b") for r in t["building"].select("id").collect() for n in ("uuid", "iri")],
        "cityobject_id long, attrname string, strval string, urival string"))
    assert sorted(r["building_height"] for r in layer.collect()) == [5.0, 10.0]
