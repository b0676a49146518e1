"""GeoJSON feature collections → rows of properties + ``geom`` struct."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweave.functions import geom as G


def _coords(depth: int) -> str:
    t = "array<double>"
    for _ in range(depth):
        t = f"array<{t}>"
    return t


def _simple_parts(c, gtype):
    """Parts of a geometry other than a collection (NULL for unknown types)."""
    coords = F.get_json_object(c, "$.coordinates")
    v = lambda a: G.vertex(a[0], a[1], F.when(F.size(a) > 2, a[2]))
    ring = lambda r: F.transform(r, v)
    point = F.array(F.array(F.array(v(F.from_json(coords, _coords(0))))))
    line = F.array(F.array(ring(F.from_json(coords, _coords(1)))))
    poly = F.array(F.transform(F.from_json(coords, _coords(2)), ring))
    mline = F.transform(F.from_json(coords, _coords(2)), lambda ln: F.array(ring(ln)))
    mpoly = F.transform(F.from_json(coords, _coords(3)), lambda p: F.transform(p, ring))
    mpoint = F.transform(F.from_json(coords, _coords(1)), lambda p: F.array(F.array(v(p))))
    return (F.when(gtype == "POINT", point).when(gtype == "LINESTRING", line).when(gtype == "POLYGON", poly)
            .when(gtype == "MULTILINESTRING", mline).when(gtype == "MULTIPOLYGON", mpoly)
            .when(gtype == "MULTIPOINT", mpoint))


def geojson_geometry(col, srid: int = 4326):
    """GeoJSON geometry text → geom struct (Point, LineString, Polygon and their Multi* forms; other types have NULL parts)."""
    c = F.col(col) if isinstance(col, str) else col
    gtype = F.upper(F.get_json_object(c, "$.type"))
    return F.when(c.isNotNull(), G.make_geom(gtype, _simple_parts(c, gtype), srid))


def geojson_members(col, srid: int = 4326):
    """GeoJSON geometry text → array of geom structs: the members of a GeometryCollection, else the geometry alone.

    NULL for a missing geometry, an empty array for an empty collection; a collection inside a collection has NULL parts.
    """
    c = F.col(col) if isinstance(col, str) else col
    members = F.from_json(F.get_json_object(c, "$.geometries"), "array<string>")
    several = F.lower(F.get_json_object(c, "$.type")) == "geometrycollection"
    return F.when(c.isNotNull(), F.when(several, F.transform(members, lambda m: geojson_geometry(m, srid)))
                  .otherwise(F.array(geojson_geometry(c, srid))))


def _before(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all earlier segments of the file, with ``_base`` and ``_end``, the sums at the block's ends.

    Summed inside a block of the file, then over the blocks' totals (one row a block), so no file is one group.
    """
    block, earlier = Window.partitionBy("file", "block").orderBy("seq"), Window.partitionBy("file").orderBy("block")
    totals = df.groupBy("file", "block").agg(F.sum(value).alias("_total"))
    totals = totals.select("file", "block", (F.sum("_total").over(earlier) - F.col("_total")).alias("_base"), F.sum("_total").over(earlier).alias("_end"))
    inside = F.sum(value).over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    return df.withColumn("_in", inside).join(totals, ["file", "block"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_in")


def split_collections(spark: SparkSession, path: str) -> DataFrame:
    """Objects directly inside the root object of JSON files, as ``file, no, json``; one file is read by many tasks.

    The text is read in segments between opening braces, so any white space and order of keys will do.  Running sums tell for
    each segment whether it starts in a string (quotes before it) and how deep it lies; segments are joined by object.  ``json``
    may end in what follows the object; JSON readers stop at its end.  Files hold one valid JSON object; an empty file has no rows.
    """
    raw = spark.read.option("lineSep", "{").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")
    # escaped characters stand only in strings; without them, every second piece between quotes is text of a string
    pieces = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)

    def closing(odd: int):
        text = F.array_join(F.filter(pieces, lambda _x, i: i % 2 == odd), "")
        return F.length(text) - F.length(F.replace(text, F.lit("}"), F.lit("")))

    marked = raw.select("file", "block", "seq", "value", (F.size(pieces) - 1).alias("quotes"), closing(0).alias("c0"), closing(1).alias("c1"))
    first = (F.col("block") == 0) & (F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")) == 1)
    s = _before(marked.withColumn("opens", F.when(first, 0).otherwise(1)), "quotes", "q")
    quoted = F.col("q") % 2 == 1
    s = s.withColumn("opens", F.when(quoted, 0).otherwise(F.col("opens"))).withColumn(
        "delta", F.col("opens") - F.when(quoted, F.col("c1")).otherwise(F.col("c0")))
    s = _before(s.drop("quotes", "q", "c0", "c1", "_base", "_end"), "delta", "depth")
    s = s.withColumn("starts", ((F.col("opens") == 1) & (F.col("depth") == 1)).cast("int"))
    s = _before(s.drop("opens", "delta", "depth", "_base", "_end"), "starts", "earlier").withColumn("no", F.col("earlier") + F.col("starts"))
    # an object inside one block is joined where its block is; only objects at a block's two ends are shuffled again
    text = F.array_join(F.sort_array(F.collect_list(F.struct("seq", "value")))["value"], "{")
    pieces = s.where("no > 0").groupBy("file", "block", "no", "_base", "_end").agg(text.alias("json"))
    inner = (F.col("no") > F.col("_base")) & (F.col("no") < F.col("_end"))
    rims = pieces.where(~inner).groupBy("file", "no").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "json")))["json"], "{").alias("json"))
    whole = pieces.where(inner).select("file", "no", "json").unionByName(rims)
    return whole.select("file", "no", F.concat(F.lit("{"), "json").alias("json"))


def read_collections(spark: SparkSession, path: str, properties_schema: str, srid: int = 4326, geom_col: str = "members") -> DataFrame:
    """S2 for large files: ``FeatureCollection`` files, each read by many tasks → ``properties.*`` + an array of geometries.

    The array holds the members of a GeometryCollection, otherwise one geometry (``geojson_members``).  Objects beside the
    features (``crs``) are left out; features without properties have NULL columns.
    """
    schema = f"type string, properties struct<{properties_schema}>, geometry string"
    f = split_collections(spark, path).select(F.from_json("json", schema).alias("f")).where(F.col("f.type") == "Feature")
    return f.select("f.properties.*", geojson_members(F.col("f.geometry"), srid).alias(geom_col))


def read_features(spark: SparkSession, path: str, properties_schema: str, srid: int = 4326,
                  geom_col: str = "geom", lines: bool = False) -> DataFrame:
    """``FeatureCollection`` files → one row per feature: ``properties.*`` + ``geom``.

    An explicit properties schema is required (integer coordinates would infer as
    BIGINT, a single nested object as struct instead of array); the geometry is
    read as raw JSON text and decoded by type.  A collection is one JSON value, so one file is one task; with
    ``lines`` the files hold one feature per line (newline-delimited GeoJSON) and are split like any text.
    """
    feature = f"properties struct<{properties_schema}>, geometry string"
    if lines:
        f = spark.read.schema(feature).json(path)
        return f.where("properties is not null or geometry is not null").select("properties.*", geojson_geometry("geometry", srid).alias(geom_col))
    schema = f"features array<struct<properties: struct<{properties_schema}>, geometry: string>>"
    raw = spark.read.option("multiLine", "true").schema(schema).json(path)
    f = raw.select(F.explode("features").alias("f"))
    return f.select("f.properties.*", geojson_geometry(F.col("f.geometry"), srid).alias(geom_col))
