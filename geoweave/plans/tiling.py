"""Tile trees of the three specs (C12) over buildings placed by document number.

Stand-in: document k is a building of 1/64 degree at (gx / 16, gy / 32) with a ground face and, unless k % 4 = 0, a roof.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import geom as G
from geoweave.operators import tiles as T
from geoweave.plans.registry import query
from geoweave.plans.sqlmath import sql_transform
from geoweave.plans.tables import read

EXTENT, DEPTH, CAPACITY = (0.0, 0.0, 64.0), 10, 20


def _surfaces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents", "doc_id").select(
        k.alias("k"), ((k * 37) % 1009 / 16.0).alias("lon"), ((k % 1013) * (k % 1013) % 1013 / 32.0).alias("lat"),
        (k % 5).cast("double").alias("z"), (k % 4 + 3).cast("double").alias("h"))
    def face(cls, z):
        return F.struct(F.lit(cls).alias("cls"), z.alias("z"))

    ground, roof = face(35, F.col("z")), face(33, F.col("z") + F.col("h"))
    faces = F.explode(F.when(F.col("k") % 4 != 0, F.array(ground, roof)).otherwise(F.array(ground)))
    s = d.select("k", "lon", "lat", faces.alias("f")).select("k", "lon", "lat", "f.cls", "f.z").withColumn("sid", F.col("k") * 100 + F.col("cls"))
    thematic = s.select(F.col("sid").alias("id"), F.col("k").alias("building_id"), F.col("sid").alias("lod2_multi_surface_id"), F.col("cls").alias("objectclass_id"))
    geometry = s.select(F.col("sid").alias("root_id"), G.box(F.col("lon"), F.col("lat"), F.col("lon") + 1 / 64, F.col("lat") + 1 / 64, F.col("z"), 4326).alias("geometry"))
    return thematic, geometry


_FACES = """
WITH b AS (SELECT doc_id AS k, (doc_id * 37) % 1009 AS gx, (doc_id % 1013) * (doc_id % 1013) % 1013 AS gy, doc_id % 5 AS z, 3 + doc_id % 4 AS h FROM documents),
f AS (SELECT k, gx, gy, 35 AS cls, z FROM b UNION ALL SELECT k, gx, gy, 33, z + h FROM b WHERE k % 4 <> 0)"""
_V = "SELECT k, cls, gx, gy, gx / 16.0 + dx / 64.0 AS lon, gy / 32.0 + dy / 64.0 AS lat, z FROM f, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) d(dx, dy)"
_BOX = "min(x_min) AS x_min, max(x_max) AS x_max, min(y_min) AS y_min, max(y_max) AS y_max, min(z_min) AS z_min, max(z_max) AS z_max"
_TILES = f"""{_FACES},
v AS ({sql_transform(_V, ["k", "cls", "gx", "gy"], "lon", "lat", 4326, 4978, "z")}),
s AS (SELECT k, cls, gx, gy // 2 AS gy, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM v GROUP BY ALL),
bl AS (SELECT k, gx, gy, {_BOX} FROM s GROUP BY k, gx, gy),
feat AS (SELECT 'lod2-features' AS spec, k * 100 + cls AS id, cls AS class, gx, gy, x_min, x_max, y_min, y_max, z_min, z_max FROM s
  UNION ALL SELECT spec, k, NULL, gx, gy, x_min, x_max, y_min, y_max, z_min, z_max FROM bl, (VALUES ('lod2-buildings'), ('lod1_lod2-buildings')) w(spec)),
lv AS (SELECT *, gx >> (10 - l) AS tx, gy >> (10 - l) AS ty, CAST(l AS INTEGER) AS level FROM feat, range(11) r(l)),
n AS (SELECT spec, level, tx, ty, count(*) AS n_features, {_BOX} FROM lv GROUP BY spec, level, tx, ty),
p AS (SELECT *, sum(n_features) OVER (PARTITION BY spec, level, tx >> 1, ty >> 1) AS family FROM n),
t AS (SELECT *, n_features <= {CAPACITY} OR level = 10 AS leaf, level || '/' || tx || '/' || ty AS tile,
    CASE WHEN level > 0 THEN (level - 1) || '/' || (tx >> 1) || '/' || (ty >> 1) END AS parent,
    sqrt((x_max - x_min) ** 2 + (y_max - y_min) ** 2 + (z_max - z_min) ** 2) / 2 AS error
  FROM p WHERE level = 0 OR family > {CAPACITY})"""
_ROUND = "round(x_min, 3) AS x_min, round(x_max, 3) AS x_max, round(y_min, 3) AS y_min, round(y_max, 3) AS y_max, round(z_min, 3) AS z_min, round(z_max, 3) AS z_max"


@query("tile_tree", f"""{_TILES}
SELECT spec, tile, parent, level, CASE WHEN leaf THEN CASE spec WHEN 'lod1_lod2-buildings' THEN 1 ELSE 2 END END AS lod,
  leaf AND spec <> 'lod1_lod2-buildings' AS leaf, n_features,
  CASE WHEN leaf AND spec <> 'lod1_lod2-buildings' THEN 0.0 ELSE round(error, 3) END::DOUBLE AS error, {_ROUND} FROM t
UNION ALL SELECT spec, tile || '/lod2', tile, level, 2, TRUE, n_features, 0.0, {_ROUND} FROM t WHERE leaf AND spec = 'lod1_lod2-buildings'
""")
def tile_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive tiles of the three specs with boxes in 4978."""
    t = T.tile_tree(T.tile_features(*_surfaces(spark, sf_dir), 4326), CAPACITY, DEPTH, EXTENT)
    return t.select(*[F.round(c, 3).alias(c) if c in [*T.AXES, "error"] else F.col(c) for c in t.columns])


@query("tile_members", f"""{_TILES}
SELECT lv.spec, lv.id, CAST(lv.class AS INTEGER) AS class, t.tile || CASE lv.spec WHEN 'lod1_lod2-buildings' THEN '/lod2' ELSE '' END AS tile
FROM lv JOIN t ON t.leaf AND lv.spec = t.spec AND lv.level = t.level AND lv.tx = t.tx AND lv.ty = t.ty
""")
def tile_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one leaf of every feature of the three specs."""
    return T.tile_members(T.tile_features(*_surfaces(spark, sf_dir), 4326), CAPACITY, DEPTH, EXTENT)
