"""Delimited files, file discovery, multi-file append, sinks, snapshots, JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions.util import q


def read_tabular(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Delimited files; types detected unless ``schema`` is given; ``''`` → NULL; header kept verbatim
    (a UTF-8 BOM before the first header is stripped by the reader)."""
    r = spark.read.option("header", "true").option("sep", sep).option("nullValue", "").option("encoding", "UTF-8")
    r = r.schema(schema) if schema else r.option("inferSchema", "true")
    return r.csv(path)


# Extension → vector/raster driver family used to group input files.
DRIVERS = {
    ".shp": "ESRI Shapefile", ".geojson": "GeoJSON", ".json": "GeoJSON", ".gpkg": "GPKG", ".csv": "CSV",
    ".gml": "GML", ".kml": "KML", ".tif": "GTiff", ".tiff": "GTiff", ".nc": "netCDF", ".osm": "OSM", ".pbf": "OSM",
    ".ttl": "Turtle", ".nt": "N-Triples", ".nq": "N-Quads", ".trig": "TriG", ".xlsx": "XLSX",
}


def scan_files(spark: SparkSession, directory: str) -> DataFrame:
    """S3: recurse a directory → ``(path, driver, size)``; Shapefile side-car files are dropped.

    Uses the ``binaryFile`` source with only path/length selected, so file contents
    are never read.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
             .select("path", F.col("length").alias("size")))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    mapping = F.create_map(*[F.lit(x) for kv in DRIVERS.items() for x in kv])
    sidecar = ext.isin(".shx", ".dbf", ".prj", ".cpg", ".sbn", ".sbx", ".qix")
    return files.where(~sidecar).select("path", F.coalesce(mapping[ext], F.lit("unknown")).alias("driver"), "size")


def group_by_driver(files: DataFrame) -> DataFrame:
    """S3/A5: multimap driver → sorted paths."""
    return files.groupBy("driver").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def append_files(frames: Mapping[str, DataFrame], table: str | None = None) -> DataFrame | dict[str, DataFrame]:
    """Many files into one layer (first truncates, the rest append ≡ one union with missing columns
    as NULL); without a table name every file stays its own table, keyed by file stem.

    For frames that come from different readers; files of one format and schema are better read in one scan
    (:func:`read_files`), whose plan does not grow with their number."""
    if table is None:
        return dict(frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames.values())


def read_files(spark: SparkSession, paths: Sequence[str], fmt: str, schema: str | None = None, **options) -> DataFrame:
    """Any number of files of one format as one scan; ``_source`` names the file of each row.

    Without a schema Parquet and ORC merge the files' schemas, so a column that a file lacks is NULL there.
    """
    reader = spark.read.format(fmt).options(**options)
    reader = reader.schema(schema) if schema else reader.option("mergeSchema", "true")
    return reader.load(list(paths)).withColumn("_source", F.col("_metadata.file_path"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None,
                fmt: str = "parquet") -> None:
    """Truncate (``overwrite``) or ``append``; parent folders are created as needed."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def select_fields(df: DataFrame, spec: str) -> DataFrame:
    """``"id, height,@relations"`` → projection (spaces tolerated, names quoted)."""
    return df.select(*[F.col(q(c.strip())) for c in spec.split(",") if c.strip()])


def name_geometry(df: DataFrame, geom_col: str, new_name: str = "geom", fid: str | None = "fid",
                  order_by: Sequence[str] | None = None) -> DataFrame:
    """Rename the geometry column and add a deterministic integer feature id."""
    from geoweave.operators.relational import with_ordinal

    out = df.withColumnRenamed(geom_col, new_name)
    if fid:
        out = with_ordinal(out, list(order_by or [c for c in out.columns if c != new_name][:1]), fid)
    return out


def register_crs(crs: DataFrame, new: DataFrame) -> DataFrame:
    """Append custom CRS rows ``(srid, auth_name, auth_srid, srtext, proj4text)``; a duplicate srid raises."""
    dup = new.select("srid").join(crs.select("srid"), "srid", "left_semi")
    if not dup.isEmpty():
        raise ValueError(f"SRID already registered: {[r[0] for r in dup.limit(5).collect()]}")
    return crs.unionByName(new)


def from_text(spark: SparkSession, texts: Sequence[str], fmt: str, schema: str, **options) -> DataFrame:
    """Load from in-memory strings (one record per string) — csv / json / xml."""
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    parse = {"csv": F.from_csv, "json": F.from_json, "xml": F.from_xml}[fmt]
    return df.select(parse("value", schema, options).alias("r")).select("r.*")


def write_snapshot(df: DataFrame, path: str, lineage: str) -> None:
    """Export the current rows of one lineage (partitioned by lineage, overwrite that partition only)."""
    (df.where(F.col("lineage") == lineage).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("lineage").parquet(path))


def read_previous(spark: SparkSession, path: str, lineage: str) -> DataFrame:
    """Reload a lineage's previous export so ids survive re-import (partition-pruned read)."""
    return spark.read.parquet(path).where(F.col("lineage") == lineage)


def read_jdbc(spark: SparkSession, url: str, table: str, user: str, password: str, **options) -> DataFrame:
    """Any table by JDBC URL + credentials (partitioned reads via ``partitionColumn`` options)."""
    return spark.read.jdbc(url, table, properties={"user": user, "password": password, **options})


def write_jdbc(df: DataFrame, url: str, table: str, user: str, password: str, mode: str = "append") -> None:
    df.write.jdbc(url, table, mode=mode, properties={"user": user, "password": password})
