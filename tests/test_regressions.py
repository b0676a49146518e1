"""Regressions: one test for each fault that small stand-in data did not show."""

import pytest
from pyspark.sql import functions as F

from geoweave.functions import terms as T
from geoweave.operators import catalog, city, closure, hooks, network, raster, relational, styles
from geoweave.operators.mapping import QUAD_SCHEMA
from geoweave.sources import rdf
from tests.conftest import SF_SMALL, rows


def test_ordinals_are_a_permutation_with_carried_columns(spark):
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "5")
    try:
        df = spark.range(400_000, numPartitions=8).select(F.xxhash64("id").alias("k"), F.concat(F.lit("x"), "id").alias("carried"), "id")
        got = relational.with_ordinal(df.repartition(4, "carried"), ["k"])
        n, distinct, top, wrong = got.agg(F.count("*"), F.countDistinct("ordinal"), F.max("ordinal"),
                                          F.sum((F.concat(F.lit("x"), "id") != F.col("carried")).cast("int"))).first()
        assert (n, distinct, top, wrong) == (400_000, 400_000, 400_000, 0)
        first = got.orderBy("ordinal").limit(50).collect()
        assert [r.k for r in first] == sorted(r.k for r in first)
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")


def test_append_keeps_every_edge(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "way_id int, e string")
    b = spark.createDataFrame([(2, "x"), (3, "d"), (3, "e")], "way_id int, e string")
    assert rows(network.append_network(a, b)) == [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "e")]


def test_edges_have_lines_and_lost_nodes_are_listed(spark):
    nodes = spark.createDataFrame([(k, float(k), 1.0) for k in (1, 2, 3)], "node_id int, lon double, lat double")
    ways = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 9), (7, 4, 3)], "way_id int, pos int, node_id int")
    edges = network.build_ways(ways, nodes)
    assert [r.wkt for r in edges.collect()] == ["LINESTRING (1.0 1.0, 2.0 1.0, 3.0 1.0)"]
    assert rows(network.missing_nodes(ways, nodes)) == [(7, 3, 9)]
    assert {r.wkt for r in network.build_vertices(edges, nodes).collect()} == {"POINT (1.0 1.0)", "POINT (3.0 1.0)"}
    cost = network.with_costs(edges, spark.createDataFrame([(7, 5, 36.0, "yes")], "way_id int, class_id int, maxspeed_kmh double, oneway string")).first()
    assert (cost.one_way, cost.reverse_cost) == (1, -1.0) and cost.cost > 0 and abs(cost.cost_s - cost.cost / 10) < 1e-6


def test_negative_lengths_are_refused(spark):
    e = spark.createDataFrame([(1, 2, -1.0)], "source int, target int, length_m double")
    with pytest.raises(ValueError):
        network.shortest_paths(e, spark.createDataFrame([(1,)], "source int"))


def test_literal_escapes(spark):
    lines = [r'<a:s> <a:p> "caf\u00E9 \U0001F600 \t|\b|\f|\\u0041 \"q\"" .', r'<a:s> <a:p> "plain"@en .']
    quads, rejects = rdf.parse_nquads(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rejects.count() == 0
    assert sorted(r.o for r in quads.collect()) == sorted(["caf\u00e9 \U0001f600 \t|\b|\f|\\u0041 \"q\"", "plain"])


def test_view_parameters_are_not_casts_or_text(spark):
    sql = "select :n + 1 as a, '10:30'::string as b, 'it''s :x' as c"
    assert tuple(hooks.param_view(spark, sql, {"n": 4}).first()) == (5, "10:30", "it's :x")
    with pytest.raises(ValueError):
        hooks.param_view(spark, "select :m", {})


def test_closure_keeps_named_graphs_and_reads_its_input_twice(spark):
    q = spark.createDataFrame([("g1", "a", T.RDF_TYPE, "A", "iri", None, None), (None, "a", T.RDF_TYPE, "A", "iri", None, None),
                               (None, "A", closure.SUBCLASS, "B", "iri", None, None)], QUAD_SCHEMA)
    got = closure.rdfs_closure(q)
    assert got.where("g is not null").count() == 1 and got.where("g is null").count() == 9
    table = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    quads = table.select(F.lit(None).cast("string").alias("g"), F.col("n_name").alias("s"), F.lit("p").alias("p"), F.col("n_name").alias("o"),
                         F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"), F.lit(None).cast("string").alias("o_lang"))
    plan = closure.rdfs_closure(quads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2


def test_incoming_objects_once_each(spark):
    have = spark.createDataFrame([("x", "old")], "gmlid string, lineage string")
    new = spark.createDataFrame([("y",), ("y",), ("x",)], "gmlid string")
    assert rows(city.import_objects(have, new, "new", append=True)) == [("x", "old"), ("y", "new")]


def test_emptied_reference_list(spark):
    base = "http://c/"
    names = spark.createDataFrame([("d1", "x"), ("d2", "y")], "name string, description string")
    quads = catalog.upsert_catalog(spark.createDataFrame([], QUAD_SCHEMA), names, "2024-01-01T00:00:00Z", base)
    refs = spark.createDataFrame([("d1", "d2")], "name string, ref string")
    quads = catalog.refresh_references(quads, refs, names)
    assert quads.where(F.col("p") == catalog.REFERENCES).count() == 1
    assert catalog.refresh_references(quads, refs.where("false"), names).where(F.col("p") == catalog.REFERENCES).count() == 0


def test_times_table(spark):
    files = spark.createDataFrame([("a.nc", 1, 2), ("b.nc", 2, 2)], "filename string, pos int, n_bands int")
    times = spark.createDataFrame([(k, f"2024020{k}") for k in (1, 2, 3)], "pos int, time_text string")
    plain = raster.raster_times(files, times, None, None, "yyyymmdd")
    assert rows(plain) == [(1, "a.nc", 1, "1", "2024/02/01"), (2, "a.nc", 2, "2", "2024/02/02"), (3, "b.nc", 1, "3", "2024/02/03")]
    timed = raster.raster_times(files, times, "yyyyMMdd")
    assert [r.label for r in timed.orderBy("index").collect()][0] == "2024-02-01T00:00:00Z"


def test_style_rules_read_features_once(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "b"), (3, None, "z")], "id int, u string, v string")
    rules = spark.createDataFrame([("u", "a", "red"), ("v", "b", "blue"), ("id", "3", "grey"), ("none", "a", "x")], "property string, value string, colour string")
    assert rows(styles.apply_style_rules(df, rules), "id", "rule_property", "colour") == [(1, "u", "red"), (1, "v", "blue"), (2, "v", "blue"), (3, "id", "grey")]
    assert styles.apply_style_rules(df, rules, exclusive=True).count() == 3


def _boxes(*corners):
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]] for x0, y0, x1, y1 in corners]


def _area(parts):
    ring = lambda r: abs(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())) / 2
    return round(sum(ring(p[0]) - sum(ring(h) for h in p[1:]) for p in parts), 9)


@pytest.mark.parametrize(("faces", "area", "shells", "holes"), [
    (_boxes((0, 0, 4, 4), (1, 1, 3, 3)), 16, 1, 0),  # box in a box
    (_boxes((0, 0, 4, 4), (2, 1, 6, 4)), 22, 1, 0),  # overlap
    (_boxes((0, 0, 4, 2), (0, 0, 2, 2), (2, 0, 4, 2)), 8, 1, 0),  # floor and split roof
    (_boxes((0, 0, 4, 2), (0, 2, 2, 4), (2, 2, 4, 4)), 16, 1, 0),  # T-junction
    (_boxes((0, 0, 1, 1), (1, 1, 2, 2)), 2, 2, 0),  # corner touch
    (_boxes((0, 0, 3, 1), (0, 2, 3, 3), (0, 0, 1, 3), (2, 0, 3, 3)), 8, 1, 1),  # frame of overlapping bars
    (_boxes((0, 0, 5, 5)) + [[[(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]]], 25, 1, 0),
    ([[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]], 2, 2, 0),  # bow-tie
    ([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]], 12, 1, 1),
    ([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]] + _boxes((2, 2, 6, 3)), 15, 1, 1),
    ([[[(0.1, 0.2), (3.3, 0.7), (1.7, 2.9), (0.1, 0.2)]], [[(1.0, 0.1), (2.9, 2.2), (0.4, 2.0), (1.0, 0.1)]]], None, 1, 0),
    ([[[(0, 0), (1, 0), (0, 0)]]], 0, 0, 0)])
def test_union_of_polygons_in_any_position(faces, area, shells, holes):
    from geoweave.operators.union import overlay

    for shift in (0.0, 530_000.25):
        moved = [[[(x + shift, y + shift) for x, y in r] for r in f] for f in faces]
        parts, _ = overlay(moved)
        assert len(parts) == shells and sum(len(p) - 1 for p in parts) == holes
        if area is not None:
            local = [[r - shift for r in p] for p in parts]
            assert abs(_area(local) - area) < 1e-6


def test_inverse_projections_against_published_points(spark):
    from geoweave.functions import crs
    from tests.test_geom import run_stages

    # worked example of the Ordnance Survey's guide to coordinate systems (Airy 1830, OSGB36)
    back = run_stages(crs._tm_inverse_stages(crs.AIRY1830, **crs.BNG), 651409.903, 313177.270)
    assert abs(back["y"] - (52 + 39 / 60 + 27.2531 / 3600)) < 3e-8 and abs(back["x"] - (1 + 43 / 60 + 4.5177 / 3600)) < 3e-8
    for code, lon, lat in ((27700, -2.5, 53.1), (27700, 1.2, 51.9), (32633, 14.2, 48.7), (25832, 9.9, 53.5)):
        there = run_stages(crs.stages(4326, code), lon, lat)
        home = run_stages(crs.stages(code, 4326), there["x"], there["y"])
        assert abs(home["x"] - lon) < 2e-7 and abs(home["y"] - lat) < 2e-7
    df = spark.createDataFrame([(27700, 400000.0, 300000.0), (4326, 10.0, 50.0)], "srid int, x double, y double")
    from geoweave.functions import geom as G
    df = df.select(G.make_geom("POINT", F.array(F.array(F.array(G.vertex(F.col("x"), F.col("y"))))), F.col("srid")).alias("geom"))
    got = crs.reproject_df(df, "geom", 4326).select(F.col("geom")["parts"][0][0][0].alias("p"), F.col("geom")["srid"].alias("s")).collect()
    assert {r.s for r in got} == {4326} and sorted(round(r.p.x) for r in got) == [-2, 10]


def test_envelope_keeps_z(spark):
    from geoweave.functions import geom as G

    ring = F.array(*[G.vertex(F.lit(x), F.lit(y), F.lit(z)) for x, y, z in ((0.0, 0.0, 7.0), (2.0, 0.0, 9.0), (2.0, 3.0, 8.0), (0.0, 0.0, 7.0))])
    df = spark.range(1).select(G.make_geom("POLYGON", F.array(F.array(ring))).alias("g"))
    assert tuple(df.select(G.st_zmin(G.st_envelope("g")), G.st_zmax(G.st_envelope("g")), G.st_area(G.st_envelope("g"))).first()) == (7.0, 9.0, 6.0)
