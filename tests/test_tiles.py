"""Tile trees (containment, one leaf a feature, all three specs)."""

from pyspark.sql import functions as F

from geoweave.functions import geom as G
from geoweave.operators import tiles as T
from tests.conftest import rows


def _city(spark, n):
    k = F.col("id")
    s = spark.range(n).select(k.alias("b"), (F.pow(k % 17, F.lit(2)) / 30).alias("x"), ((k * 7) % 23 / 5).alias("y"),
                              F.explode(F.array(F.lit(33), F.lit(35))).alias("c")).withColumn("sid", F.col("b") * 100 + F.col("c"))
    thematic = s.select(F.col("sid").alias("id"), F.col("b").alias("building_id"), F.col("sid").alias("lod2_multi_surface_id"),
                        F.col("c").alias("objectclass_id"))
    return thematic, s.select(F.col("sid").alias("root_id"),
                              G.box(F.col("x"), F.col("y"), F.col("x") + 0.01, F.col("y") + 0.01, F.lit(2.0), 4326).alias("geometry"))


def test_parents_contain_children_and_members_one_leaf(spark):
    f = T.tile_features(*_city(spark, 300), 4326).cache()
    tiles = {(r.spec, r.tile): r for r in T.tile_tree(f, 10, 12).collect()}
    assert {s for s, _ in tiles} == {T.SPLIT_SURFACES, T.BUILDINGS, T.BUILDINGS_WITH_BLOCKS}
    for (spec, tile), r in tiles.items():
        if r.parent is None:
            assert tile == "0/0/0"
            continue
        up = tiles[spec, r.parent]
        assert not up.leaf and up.error >= r.error
        assert all((up[c] <= r[c]) if c.endswith("_min") else (up[c] >= r[c]) for c in T.AXES)
    counts = {}
    for spec, _id, _cls, tile in T.tile_members(f, 10, 12).collect():
        counts[spec, tile] = counts.get((spec, tile), 0) + 1
    assert counts == {key: r.n_features for key, r in tiles.items() if r.leaf}
    assert sum(n for (s, _), n in counts.items() if s == T.SPLIT_SURFACES) == 600
    assert sum(n for (s, _), n in counts.items() if s == T.BUILDINGS) == 300


def test_one_place_no_rows_and_missing_geometry(spark):
    thematic, surfaces = _city(spark, 1)
    many = T.tile_features(thematic, surfaces, 4326).where(F.col("spec") == T.BUILDINGS).withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(50))))
    leaf = T.tile_tree(many, 10, 3).where("leaf").collect()
    assert [(r.level, r.n_features) for r in leaf] == [(3, 50)]  # equal places are never separated
    assert T.tile_members(many, 10, 3).count() == 50
    none = T.tile_features(thematic, surfaces.withColumn("geometry", F.lit(None).cast(G.GEOM)), 4326)
    assert rows(T.tile_tree(none)) == [] and rows(T.tile_members(none)) == []
