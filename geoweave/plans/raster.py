"""Raster queries on a pixel table derived from ``embeddings`` (row = vec_id, col = position)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators import raster as RS
from geoweave.operators.relational import with_ordinal
from geoweave.operators.styles import colour_map
from geoweave.plans.registry import query
from geoweave.plans.sqlmath import sql_transform
from geoweave.plans.tables import read

PIXELS_SQL = ("SELECT 'emb' AS raster, 1 AS band, vec_id AS row, CAST(i - 1 AS BIGINT) AS col, CAST(v AS DOUBLE) AS value "
              "FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")

# Elevation colour stops (quantity, colour, opacity) of the example colour map.
ELEVATION_STOPS = [
    (-100.0, "#AAFFAA", 1.0),
    (-0.00000002, "#AAFFAA", 1.0),
    (-0.00000001, "#AAFFAA", 0.0),
    (0.0, "#AAFFAA", 0.0),
    (0.00000001, "#AAFFAA", 0.0),
    (0.00000002, "#AAFFAA", 1.0),
    (400.0, "#00FF00", 1.0),
    (800.0, "#FFFF00", 1.0),
    (1200.0, "#FF7F00", 1.0),
    (1600.0, "#BF7F3F", 1.0),
    (2000.0, "#000000", 1.0),
]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select(F.lit("emb").alias("raster"), F.lit(1).alias("band"), F.col("vec_id").alias("row"),
                    F.posexplode("embedding").alias("col", "value")).select(
        "raster", "band", "row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))


@query("raster_tile", f"""
WITH p AS ({PIXELS_SQL})
SELECT raster, band, floor(row / 16)::BIGINT AS tile_row, floor(col / 16)::BIGINT AS tile_col,
       max(row % 16) + 1 AS height, max(col % 16) + 1 AS width, count(value) AS n_valid,
       min(value) AS vmin, max(value) AS vmax, round(sum(value), 4) AS vsum,
       round(sum(value * ((row % 16) * 16 + col % 16 + 1)), 4) AS checksum
FROM p GROUP BY 1, 2, 3, 4
""")
def raster_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16×16 tiling (row-major values), then per-tile constraints and an order checksum."""
    t = RS.tile(pixels(spark, sf_dir), 16, 16)
    chk = F.aggregate(F.arrays_zip("values", "offsets"), F.lit(0.0),
                      lambda a, x: a + x["values"] * (x["offsets"] + 1))
    return RS.tile_metadata(t).select(
        "raster", "band", "tile_row", "tile_col", F.col("height").cast("bigint").alias("height"),
        F.col("width").cast("bigint").alias("width"), F.col("n_valid").cast("bigint").alias("n_valid"), "vmin", "vmax",
        F.round("vsum", 4).alias("vsum"), F.round(chk, 4).alias("checksum"))


@query("raster_roundtrip", PIXELS_SQL)
def raster_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 inverse: tiles → pixels reproduces the pixel table exactly."""
    return RS.untile(RS.tile(pixels(spark, sf_dir), 16, 16), 16, 16).select(
        "raster", "band", "row", "col", "value")


@query("raster_resample", f"""
WITH p AS ({PIXELS_SQL})
SELECT raster, band, floor(row / 2)::BIGINT AS row, floor(col / 2)::BIGINT AS col, round(avg(value), 6) AS value
FROM p GROUP BY 1, 2, 3, 4
""")
def raster_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear resampling to half resolution (target cells join their source neighbours)."""
    w = RS.warp(pixels(spark, sf_dir), 0.5, "bilinear")
    return w.select("raster", "band", "row", "col", F.round("value", 6).alias("value"))


@query("raster_mosaic", f"""
WITH p AS ({PIXELS_SQL}),
u AS (
  SELECT band, row, col, value, 'a.tif' AS location, 1 AS prio FROM p
  UNION ALL
  SELECT band, row, col + 32, value, 'b.tif', 2 FROM p WHERE row % 3 = 0)
SELECT band, row, col, arg_max(value, prio) AS value, arg_max(location, prio) AS location
FROM u GROUP BY band, row, col
""")
def raster_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping rasters as one layer; the higher-priority file wins per pixel."""
    p = pixels(spark, sf_dir)
    b = p.where(F.col("row") % 3 == 0).withColumn("col", F.col("col") + 32)
    px, _index = RS.mosaic([(p, 1, "a.tif"), (b, 2, "b.tif")])
    return px


def _colour_sql(v: str) -> tuple[str, str]:
    hexc = lambda a, b, t: f"upper(lpad(to_hex(CAST(round({a} + ({b} - {a}) * {t}) AS INTEGER)), 2, '0'))"
    cs, os_ = [f"WHEN {v} <= {ELEVATION_STOPS[0][0]!r} THEN '{ELEVATION_STOPS[0][1]}'"], [
        f"WHEN {v} <= {ELEVATION_STOPS[0][0]!r} THEN {ELEVATION_STOPS[0][2]!r}"]
    for (q0, c0, o0), (q1, c1, o1) in zip(ELEVATION_STOPS, ELEVATION_STOPS[1:]):
        t = f"(({v} - ({q0!r})) / ({q1!r} - ({q0!r})))"
        ch = " || ".join(hexc(int(c0[1 + 2 * i:3 + 2 * i], 16) * 1.0, int(c1[1 + 2 * i:3 + 2 * i], 16), t) for i in range(3))
        cs.append(f"WHEN {v} <= {q1!r} THEN '#' || {ch}")
        os_.append(f"WHEN {v} <= {q1!r} THEN {o0!r} + ({o1!r} - {o0!r}) * {t}")
    last = ELEVATION_STOPS[-1]
    return (f"CASE {' '.join(cs)} WHEN {v} IS NOT NULL THEN '{last[1]}' END",
            f"CASE {' '.join(os_)} WHEN {v} IS NOT NULL THEN {last[2]!r} END")


@query("colour_map", f"""
WITH p AS ({PIXELS_SQL})
SELECT row, col, {_colour_sql('value * 4000.0')[0]} AS colour, round({_colour_sql('value * 4000.0')[1]}, 6) AS opacity
FROM p
""")
def colour_map_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation colour map (linear RGB / opacity interpolation between stops) on scaled values."""
    p = pixels(spark, sf_dir)
    c = colour_map(F.col("value") * 4000.0, ELEVATION_STOPS)
    return p.select("row", "col", c["colour"].alias("colour"), F.round(c["opacity"], 6).alias("opacity"))


@query("raster_times", """
WITH f AS (SELECT DISTINCT 'grid_' || strftime(ts, '%Y%m%d%H') || '.nc' AS filename FROM events),
t AS (SELECT filename, regexp_extract(filename, '.*([0-9]{10}).*', 1) AS tt FROM f)
SELECT CAST(row_number() OVER (ORDER BY filename) AS INTEGER) AS index, filename, 1 AS band,
       strptime(tt, '%Y%m%d%H') AS time, strftime(strptime(tt, '%Y%m%d%H'), '%Y-%m-%dT%H:%M:%SZ') AS label
FROM t
""")
def raster_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid file per event hour; time parsed from the file name, label the same instant."""
    ev = read(spark, sf_dir, "events", "ts")
    files = ev.select(F.concat(F.lit("grid_"), F.date_format("ts", "yyyyMMddHH"), F.lit(".nc")).alias("filename")).distinct()
    files = with_ordinal(files, ["filename"], "pos")
    return RS.raster_times(files, None, "yyyyMMddHH", None, None, r".*([0-9]{10}).*")


@query("raster_times_noformat", """
WITH f AS (SELECT DISTINCT strftime(ts, '%Y%m') AS m FROM events),
slots AS (SELECT 'month_' || m || '.nc' AS filename, b.band, row_number() OVER (ORDER BY m, b.band) AS slot
          FROM f, (SELECT unnest([1, 2, 3]) AS band) b),
d AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS t FROM events),
times AS (SELECT t, row_number() OVER (ORDER BY t) AS slot FROM d)
SELECT CAST(slot AS INTEGER) AS index, filename, band, CAST(slot AS VARCHAR) AS time,
       substr(t, 1, 4) || '/' || substr(t, 5, 2) || '/' || substr(t, 7) AS label
FROM slots JOIN times USING (slot)
""")
def raster_times_noformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands per monthly file zipped with the event days; no format, so time is the index as text."""
    ev = read(spark, sf_dir, "events", "ts")
    months = ev.select(F.date_format("ts", "yyyyMM").alias("m")).distinct()
    files = months.select(F.concat(F.lit("month_"), "m", F.lit(".nc")).alias("filename"), F.col("m").cast("long").alias("pos"), F.lit(3).alias("n_bands"))
    days = ev.select(F.date_format("ts", "yyyyMMdd").alias("time_text")).distinct()
    return RS.raster_times(files, days.withColumn("pos", F.col("time_text").cast("long")), None, None, "yyyymmdd")


@query("nodata_mask", f"""
WITH p AS ({PIXELS_SQL})
SELECT row, col, CASE WHEN round(value, 1) <> 0.0 THEN round(value, 1) END AS value FROM p
""")
def nodata_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantised raster whose 0.0 cells are nodata → NULL."""
    p = pixels(spark, sf_dir).withColumn("value", F.round("value", 1))
    return RS.apply_nodata(p, 0.0).select("row", "col", "value")



@query("band_to_time", f"""
WITH p AS ({PIXELS_SQL})
SELECT raster, CAST(col % 4 + 1 AS INTEGER) AS band, row, col, value,
       'emb_' || CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (col % 4) DAY AS VARCHAR) AS layer
FROM p
""")
def band_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band is one time step; the layer is named ``var_time`` from the times table."""
    import datetime as dt

    p = pixels(spark, sf_dir).withColumn("band", (F.col("col") % 4 + 1).cast("int"))
    times = spark.createDataFrame([(i, i + 1, dt.datetime(2024, 1, 1 + i)) for i in range(4)],
                                  "index int, band int, time timestamp_ntz")
    return RS.band_to_time(p, times, "emb").select("raster", "band", "row", "col", "value", "layer")


GRANULES_SQL = f"""p AS ({PIXELS_SQL}),
g AS (SELECT 'g' || CAST(row % 5 AS VARCHAR) || '_' || CAST(t AS VARCHAR) AS location, row % 5 AS k, t,
             TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (t * 6 + (row % 5) // 3) HOUR AS time,
             CAST((row % 5) // 2 AS INTEGER) AS priority, band, row + 3 * t AS row, col, value + t AS value
      FROM p, (SELECT unnest([0, 1, 2, 3]) AS t))"""


@query("mosaic_time", f"""
WITH {GRANULES_SQL},
b AS (SELECT *, row_number() OVER (PARTITION BY band, row, col ORDER BY time DESC, priority DESC, location DESC) AS n
      FROM g WHERE time <= TIMESTAMP '2024-01-01 12:30:00' AND col BETWEEN 4 AND 40)
SELECT band, row, col, value, location, time, strftime(time, '%Y-%m-%dT%H') AS label FROM b WHERE n = 1
""")
def mosaic_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granules of several times over one another; the layer at 12:30 within a band of columns."""
    t, k = F.col("t"), F.col("row") % 5
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    steps = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    g = pixels(spark, sf_dir).withColumn("t", steps).select(
        F.concat(F.lit("g"), k.cast("string"), F.lit("_"), t.cast("string")).alias("location"),
        (start + F.make_dt_interval(hours=(t * 6 + F.floor(k / 3)).cast("int"))).alias("time"),
        F.floor(k / 2).cast("int").alias("priority"), "band", (F.col("row") + 3 * t).alias("row"), "col", (F.col("value") + t).alias("value"))
    granules = g.select("location", "time", "priority", F.date_format("time", "yyyy-MM-dd'T'HH").alias("label")).distinct()
    return RS.mosaic_at(g, RS.granule_index(g, granules), F.lit("2024-01-01 12:30:00").cast("timestamp_ntz"),
                        (0, 2**62, 4, 40))


SHEETS_SQL = """SELECT 'r' || CAST(vec_id // 512 AS VARCHAR) AS raster, vec_id // 512 AS k, vec_id % 512 AS row,
  CAST(i - 1 AS BIGINT) AS col, CAST(v AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"""


@query("raster_warp_crs", f"""
WITH p AS ({SHEETS_SQL}),
g AS (SELECT raster, 300000.0::DOUBLE + k % 20 * 15000.0 AS x0, 200000.0::DOUBLE + k // 20 % 20 * 30000.0 AS y0, max(row) + 1 AS nr, max(col) + 1 AS nc
      FROM p GROUP BY raster, k),
f AS (SELECT unnest(range(21)) AS i),
b AS (SELECT raster, x0 + nc * 50.0 * i / 20 AS x, y0 AS y FROM g, f UNION ALL SELECT raster, x0 + nc * 50.0 * i / 20, y0 - nr * 50.0 FROM g, f
      UNION ALL SELECT raster, x0, y0 - nr * 50.0 * i / 20 FROM g, f UNION ALL SELECT raster, x0 + nc * 50.0, y0 - nr * 50.0 * i / 20 FROM g, f),
bt AS ({sql_transform("SELECT * FROM b", ["raster"], "x", "y", 27700, 4326)}),
e AS (SELECT raster, min(x) AS tx, max(y) AS ty, max(x) - min(x) AS w, max(y) - min(y) AS h FROM bt GROUP BY raster),
t AS (SELECT *, sqrt(w * w + h * h) / sqrt(CAST(nr * nr + nc * nc AS DOUBLE)) AS res FROM e JOIN g USING (raster)),
cells AS (SELECT raster, t_row, t_col, tx + (t_col + 0.5) * res AS x, ty - (t_row + 0.5) * res AS y
          FROM (SELECT *, unnest(range(CAST(greatest(floor(w / res + 0.5), 1) AS BIGINT))) AS t_col
                FROM (SELECT *, unnest(range(CAST(greatest(floor(h / res + 0.5), 1) AS BIGINT))) AS t_row FROM t))),
ct AS ({sql_transform("SELECT * FROM cells", ["raster", "t_row", "t_col"], "x", "y", 4326, 27700)}),
s AS (SELECT raster, t_row, t_col, (y0 - y) / 50.0 - 0.5 AS sr, (x - x0) / 50.0 - 0.5 AS sc, nr, nc FROM ct JOIN g USING (raster)),
n AS (SELECT raster, t_row, t_col, floor(sr) + i AS row, floor(sc) + j AS col, abs(floor(sr) + i - sr) AS a, abs(floor(sc) + j - sc) AS b
      FROM s, (SELECT unnest([-1, 0, 1, 2]) AS i), (SELECT unnest([-1, 0, 1, 2]) AS j)
      WHERE sr >= -0.5 AND sr < nr - 0.5 AND sc >= -0.5 AND sc < nc - 0.5),
m AS (SELECT raster, t_row, t_col, value, (CASE WHEN a <= 1 THEN 2.0 / 3 - a * a + a * a * a / 2 ELSE (2 - a) ** 3 / 6 END)
        * (CASE WHEN b <= 1 THEN 2.0 / 3 - b * b + b * b * b / 2 ELSE (2 - b) ** 3 / 6 END) AS weight
      FROM n JOIN p USING (raster, row, col) WHERE value IS NOT NULL)
SELECT raster, t_row AS row, t_col AS col, round(sum(weight * value) / sum(weight), 4) AS value FROM m GROUP BY raster, t_row, t_col
""")
def raster_warp_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of 512 rows on the British grid (50 m) to geographic coordinates with the cubic B-spline."""
    k, v = F.floor(F.col("row") / 512), pixels(spark, sf_dir)
    v = v.select(F.concat(F.lit("r"), k.cast("string")).alias("raster"), k.alias("k"), "band", (F.col("row") % 512).alias("row"), "col", "value")
    sheets = v.groupBy("raster", "k").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols")).select(
        "raster", (300000.0 + F.col("k") % 20 * 15000.0).alias("x0"), (200000.0 + F.floor(F.col("k") / 20) % 20 * 30000.0).alias("y0"),
        F.lit(50.0).alias("dx"), F.lit(50.0).alias("dy"), "n_rows", "n_cols")
    out, _grid = RS.warp_crs(v, sheets, 27700, 4326)
    return out.select("raster", "row", "col", F.round("value", 4).alias("value"))
