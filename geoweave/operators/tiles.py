"""Tile trees over 3D features in geocentric coordinates (C12), for the three tiling specs.

A feature is ``(spec, id, class, x, y, x_min … z_max)``: the centre of its footprint in the source CRS places it, its box is
in EPSG:4978.  A tree is a quadtree over a root square that all specs share; a tile of more than ``capacity`` features
is divided, down to ``depth``.  Tiles without features do not exist.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweave.functions import crs, geom as G
from geoweave.operators.city import SURFACE_LOD_KEYS, prefer_lod

# Names of the tiling specs.
SPLIT_SURFACES, BUILDINGS, BUILDINGS_WITH_BLOCKS = "lod2-features", "lod2-buildings", "lod1_lod2-buildings"

AXES = [a + end for a in "xyz" for end in ("_min", "_max")]


def _hull() -> list[Column]:
    """Aggregates that merge boxes."""
    return [(F.min if c.endswith("_min") else F.max)(c).alias(c) for c in AXES]


def tile_features(thematic: DataFrame, surfaces: DataFrame, src: int) -> DataFrame:
    """The features of all three specs: every surface alone with its class, and twice every building (class NULL).

    A building's box is merged from its faces' boxes before the shuffle; no building is gathered in one row.  A surface without
    geometry takes no part, nor does a building without any surface that has one.
    """
    faces = surfaces.where(F.size(G.vertices("geometry")) > 0).select("root_id", "geometry")
    ts = thematic.select(F.col("id").alias("surface_id"), "building_id", F.col("objectclass_id").cast("int").alias("class"),
                         prefer_lod(thematic, SURFACE_LOD_KEYS).alias("root_id"))
    ecef = faces.join(ts, "root_id").select(
        "surface_id", "building_id", "class", G.st_xmin("geometry").alias("u0"), G.st_xmax("geometry").alias("u1"),
        G.st_ymin("geometry").alias("v0"), G.st_ymax("geometry").alias("v1"),
        G.vertices(crs.st_transform("geometry", 4978, src)).alias("p"))
    boxed = ecef.select("surface_id", "building_id", "class", "u0", "u1", "v0", "v1",
                        *[(F.array_min if c.endswith("_min") else F.array_max)(F.col("p")[c[0]]).alias(c) for c in AXES])

    def merged(key: str, cls: Column, spec: str) -> DataFrame:
        g = boxed.groupBy(F.col(key).alias("id")).agg(cls.alias("class"), F.min("u0").alias("u0"), F.max("u1").alias("u1"),
                                                      F.min("v0").alias("v0"), F.max("v1").alias("v1"), *_hull())
        return g.select(F.lit(spec).alias("spec"), "id", "class", ((F.col("u0") + F.col("u1")) / 2).alias("x"),
                        ((F.col("v0") + F.col("v1")) / 2).alias("y"), *AXES)

    surface = merged("surface_id", F.min("class"), SPLIT_SURFACES)
    building = merged("building_id", F.lit(None).cast("int"), BUILDINGS).withColumn(
        "spec", F.explode(F.array(F.lit(BUILDINGS), F.lit(BUILDINGS_WITH_BLOCKS))))
    return surface.unionByName(building)


def root_extent(features: DataFrame) -> tuple[float, float, float]:
    """Lower left corner and side of the smallest square over all features' centres (one row reaches the driver)."""
    r = features.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if r[0] is None:
        return 0.0, 0.0, 1.0
    return r[0], r[1], max(r[2] - r[0], r[3] - r[1]) or 1.0


def _cells(features: DataFrame, extent: tuple[float, float, float], depth: int) -> DataFrame:
    x0, y0, side = extent
    top = 2 ** depth - 1

    def index(c: str, start: float) -> Column:
        return F.least(F.greatest(F.floor((F.col(c) - start) / side * float(2 ** depth)), F.lit(0)), F.lit(top))

    placed = features.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return placed.withColumn("ix", index("x", x0)).withColumn("iy", index("y", y0))


def _levels(cells: DataFrame, depth: int) -> DataFrame:
    return (cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
            .withColumn("tx", F.expr(f"shiftright(ix, {depth} - level)")).withColumn("ty", F.expr(f"shiftright(iy, {depth} - level)")))


def _tile_name(level: Column, tx: Column, ty: Column) -> Column:
    return F.concat_ws("/", level, tx, ty)


def _tiles(features: DataFrame, capacity: int, depth: int, extent: tuple[float, float, float]) -> DataFrame:
    """Existing tiles: features are counted by finest cell first, the levels above are sums of those rows."""
    cells = _cells(features, extent, depth).groupBy("spec", "ix", "iy").agg(F.count(F.lit(1)).alias("n"), *_hull())
    nodes = _levels(cells, depth).groupBy("spec", "level", "tx", "ty").agg(F.sum("n").alias("n_features"), *_hull())
    # a tile exists if its parent is divided; the parent's count is the sum over at most four siblings
    siblings = Window.partitionBy("spec", "level", F.shiftright("tx", 1), F.shiftright("ty", 1))
    return (nodes.withColumn("family", F.sum("n_features").over(siblings))
            .where((F.col("level") == 0) | (F.col("family") > capacity)).drop("family")
            .withColumn("leaf", (F.col("n_features") <= capacity) | (F.col("level") == depth)))


def tile_tree(features: DataFrame, capacity: int = 100, depth: int = 16, extent: tuple[float, float, float] | None = None) -> DataFrame:
    """Tiles with parent, box in 4978, feature count and geometric error, for every spec in one plan.

    The error is half the diagonal of the box, 0 for a tile with full detail, so it never grows downwards.  In the spec with
    blocks a leaf first shows each building as a block (its box, ``lod`` 1) and has one child of the same features in
    full detail.  No features: no tiles.  A cell at ``depth`` holds all its features, however many; features with equal
    ids count each.  Centres outside a given ``extent`` go to its rim, features without a centre take no part.
    """
    t = _tiles(features, capacity, depth, extent or root_extent(features))
    diagonal = reduce(lambda a, b: a + b, [F.pow(F.col(a + "_max") - F.col(a + "_min"), F.lit(2.0)) for a in "xyz"])
    blocks = F.col("leaf") & (F.col("spec") == BUILDINGS_WITH_BLOCKS)
    name = _tile_name(F.col("level"), F.col("tx"), F.col("ty"))
    parent = F.when(F.col("level") > 0, _tile_name(F.col("level") - 1, F.shiftright("tx", 1), F.shiftright("ty", 1)))
    fine = F.struct(F.concat(name, F.lit("/lod2")).alias("tile"), name.alias("parent"), F.lit(2).alias("lod"), F.lit(True).alias("leaf"))
    coarse = F.struct(name.alias("tile"), parent.alias("parent"), F.when(F.col("leaf"), F.when(blocks, 1).otherwise(2)).alias("lod"),
                      (F.col("leaf") & ~blocks).alias("leaf"))
    rows = t.withColumn("error", F.sqrt(diagonal) / 2).withColumn(
        "t", F.explode(F.when(blocks, F.array(coarse, fine)).otherwise(F.array(coarse))))
    return rows.select("spec", "t.tile", "t.parent", "level", "t.lod", "t.leaf", "n_features",
                       F.when(F.col("t.leaf"), 0.0).otherwise(F.col("error")).alias("error"), *AXES)


def tile_members(features: DataFrame, capacity: int = 100, depth: int = 16, extent: tuple[float, float, float] | None = None) -> DataFrame:
    """The leaf of every feature: ``spec, id, class, tile``; exactly one row a feature and spec."""
    extent = extent or root_extent(features)
    cells = _cells(features, extent, depth)
    leaves = _tiles(features, capacity, depth, extent).where("leaf").select("spec", "level", "tx", "ty")
    # every distinct finest cell lies in exactly one leaf
    leaf_of = _levels(cells.select("spec", "ix", "iy").distinct(), depth).join(leaves, ["spec", "level", "tx", "ty"])
    detail = F.when(F.col("spec") == BUILDINGS_WITH_BLOCKS, "/lod2").otherwise("")
    named = leaf_of.select("spec", "ix", "iy", F.concat(_tile_name(F.col("level"), F.col("tx"), F.col("ty")), detail).alias("tile"))
    return cells.join(named, ["spec", "ix", "iy"]).select("spec", "id", "class", "tile")
