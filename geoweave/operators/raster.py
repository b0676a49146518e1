"""Rasters as pixel tables.

Pixel form: ``(raster, band, row, col, value)``; tile form:
``(raster, band, tile_row, tile_col, height, width, values ARRAY<DOUBLE>)`` with
row-major values.  Tiling groups are bounded by the tile size (h × w pixels),
resampling lists the target cells of every source pixel and sums them in a
weighted aggregate, and mosaics resolve overlaps with ``max_by`` on an explicit
priority — all shuffles are keyed by pixel or tile, never by raster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions import pgcompat as pg
from geoweave.functions.crs import transform_points
from geoweave.operators.relational import with_ordinal
from geoweave.session import cut_lineage, shuffled, tasks_of

PIXEL_KEYS = ["raster", "band"]

#: Extents (one row a raster and band) that are broadcast; more are joined by a shuffle.
FEW_RASTERS = 10_000


def tile(pixels: DataFrame, h: int, w: int) -> DataFrame:
    """Pixel table → tiles of at most ``h × w`` (edge tiles are smaller), values row-major."""
    p = pixels.withColumn("tile_row", F.floor(F.col("row") / h).cast("long")).withColumn(
        "tile_col", F.floor(F.col("col") / w).cast("long"))
    cell = F.struct((F.col("row") - F.col("tile_row") * h).alias("r"), (F.col("col") - F.col("tile_col") * w).alias("c"),
                    F.col("value").cast("double").alias("v"))
    g = p.groupBy(*PIXEL_KEYS, "tile_row", "tile_col").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return g.select(*PIXEL_KEYS, "tile_row", "tile_col",
                    (F.array_max(F.transform("cells", lambda x: x["r"])) + 1).alias("height"),
                    (F.array_max(F.transform("cells", lambda x: x["c"])) + 1).alias("width"),
                    F.transform("cells", lambda x: x["v"]).alias("values"),
                    F.transform("cells", lambda x: x["r"] * w + x["c"]).alias("offsets"))


def untile(tiles: DataFrame, h: int, w: int) -> DataFrame:
    """Inverse of :func:`tile` (posexplode)."""
    t = tiles.select(*PIXEL_KEYS, "tile_row", "tile_col",
                     F.explode(F.arrays_zip("offsets", "values")).alias("p"))
    off = F.col("p.offsets")
    return t.select(*PIXEL_KEYS, (F.col("tile_row") * h + F.floor(off / w)).cast("long").alias("row"),
                    (F.col("tile_col") * w + off % w).cast("long").alias("col"), F.col("p.values").alias("value"))


def tile_metadata(tiles: DataFrame) -> DataFrame:
    """R2: the tiles with their value constraints as further columns (no second pass over the tiles)."""
    v = F.col("values")
    return tiles.select("*", F.size(F.filter(v, lambda x: x.isNotNull())).alias("n_valid"),
                        F.array_min(v).alias("vmin"), F.array_max(v).alias("vmax"),
                        F.aggregate(F.filter(v, lambda x: x.isNotNull()), F.lit(0.0), lambda a, b: a + b).alias("vsum"))


def apply_nodata(pixels: DataFrame, nodata: float) -> DataFrame:
    """The nodata value becomes NULL (no alpha band, no mask)."""
    return pixels.withColumn("value", F.when(F.col("value") != nodata, F.col("value")))


def band_to_time(pixels: DataFrame, times: DataFrame, var: str) -> DataFrame:
    """One layer per time step — band ↔ times row; layer name ``var_time`` or ``var_index``."""
    t = times.select("band", "time", "index")
    name = F.concat(F.lit(var + "_"), F.coalesce(F.col("time").cast("string"), F.col("index").cast("string")))
    return pixels.join(t, "band").withColumn("layer", name)


def raster_times(files: DataFrame, times: DataFrame | None, time_format: str | None = None, tz: str | None = None,
                 label_template: str | None = None, name_regex: str | None = None) -> DataFrame:
    """Times table ``(index, filename, band, time, label)``.

    Every band of every file (``files(filename, pos[, n_bands])``, one band by default) in order is a slot; the slots are zipped
    with ``times(time_text, pos)`` in order, the shorter list wins.  Without ``times`` each file's text comes from its
    name by ``name_regex``.  With a format ``time`` is the parsed instant and ``label`` the same instant as text; without one ``time`` is
    the row's index as text and ``label`` the text cut by the date-label rule (X17) of ``label_template``.
    """
    bands = F.col("n_bands") if "n_bands" in files.columns else F.lit(1)
    slots = files.withColumn("band", F.explode(F.sequence(F.lit(1), bands.cast("int"))))
    slots = with_ordinal(slots, ["pos", "filename", "band"], "slot")
    if times is not None:
        listed = with_ordinal(times.select("pos", "time_text"), ["pos", "time_text"], "slot")
        slots = slots.join(listed.select("slot", "time_text"), "slot")
    elif name_regex:
        slots = slots.withColumn("time_text", F.regexp_extract("filename", name_regex, 1))
    index = F.col("slot").cast("int")
    if time_format is None:
        label = pg.split_date_label("time_text", label_template) if label_template else F.col("time_text")
        return slots.select(index.alias("index"), "filename", "band", index.cast("string").alias("time"), label.alias("label"))
    out = cut_lineage(slots.withColumn("time", pg.parse_datetime("time_text", time_format, tz)))
    if not out.groupBy("time").count().where("count > 1").isEmpty():
        raise ValueError("times must be unique")
    label = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.select(index.alias("index"), "filename", "band", "time", label.alias("label"))


def _kernel(kind: str, d: Column) -> Column:
    if kind == "bilinear":
        return F.greatest(1 - F.abs(d), F.lit(0.0))
    a = F.abs(d)  # Keys cubic convolution, a = -0.5
    return (F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1)
            .when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0))


def warp(pixels: DataFrame, scale: float, resample: str = "bilinear") -> DataFrame:
    """Resample by ``scale`` (0.5 halves the resolution) with nearest / bilinear / cubic kernels.

    The target grid of each (raster, band) follows from its extent; a target cell takes the normalised weighted
    sum of its source neighbours (missing ones at the edge drop out).  Every pixel lists the few target cells that
    have it as a neighbour, and these are summed by cell: pixels are shuffled once, no grid is made and no pixel is broadcast,
    so neither gaps between row numbers nor the size of a raster matter.
    """
    if resample not in ("nearest", "bilinear", "cubic"):
        raise ValueError(resample)
    reach = REACH[resample]
    at = lambda t: (t + 0.5) / scale - 0.5
    base = lambda t: (F.round if resample == "nearest" else F.floor)(at(t)).cast("long")

    lead = 0.0 if resample == "nearest" else 0.5

    def cells(source: str, extent: str) -> Column:
        """Target rows (columns) of the grid around those that reach the source's; the bounds give way to rounding, :func:`reaches` is exact."""
        end = F.ceil((F.col(extent) + 1) * scale).cast("long") - 1
        slack = 1e-6 + F.abs(F.col(source)) * (1e-13 * scale)
        first = F.ceil((F.col(source) - reach[-1] + lead) * scale - 0.5 - slack).cast("long")
        last = F.floor((F.col(source) - reach[0] + 1 + lead) * scale - 0.5 + slack).cast("long")
        first, last = F.greatest(first, F.least(F.lit(0), end)), F.least(last, F.greatest(F.lit(0), end))
        return F.explode_outer(F.when(first <= last, F.sequence(first, last)))  # a plain explode makes its list twice, to drop empty ones first

    def reaches(source: str, target: str) -> Column:
        return (F.col(source) - base(F.col(target))).between(reach[0], reach[-1])

    ext = pixels.groupBy(*PIXEL_KEYS).agg(F.max("row").alias("_mr"), F.max("col").alias("_mc"), F.count(F.lit(1)).alias("_n"))
    n_rasters, n_pixels = ext.agg(F.count(F.lit(1)), F.sum("_n")).first()
    ext = ext.drop("_n")
    known = [F.col(c).isNotNull() for c in (*PIXEL_KEYS, "row", "col", "value")]
    source = pixels.where(reduce(lambda a, b: a & b, known)).select(*PIXEL_KEYS, "row", "col", "value")
    j = source.join(F.broadcast(ext) if n_rasters <= FEW_RASTERS else shuffled(ext), PIXEL_KEYS)
    j = j.select(*PIXEL_KEYS, "row", "col", "value", "_mc", cells("row", "_mr").alias("t_row")).where(reaches("row", "t_row"))
    j = j.select(*PIXEL_KEYS, "row", "col", "value", "t_row", cells("col", "_mc").alias("t_col")).where(reaches("col", "t_col"))
    if resample == "nearest":
        wgt = F.lit(1.0)
    else:
        wgt = _kernel(resample, F.col("row") - at(F.col("t_row"))) * _kernel(resample, F.col("col") - at(F.col("t_col")))
    # a task sums a bounded number of rows; one struct as the key: of single columns, constant ones are optimised away and the rows are shuffled again
    n = tasks_of(pixels.sparkSession, (n_pixels or 0) * math.ceil(len(reach) ** 2 * scale**2))
    j = j.select(F.struct(*PIXEL_KEYS, "t_row", "t_col").alias("_to"), wgt.alias("_w"), "value").repartition(n, "_to")
    out = j.groupBy("_to").agg(
        (F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"), F.sum("_w").alias("_ws"))
    return out.where(F.col("_ws") != 0).select(*[F.col("_to")[c].alias(c) for c in PIXEL_KEYS], F.col("_to.t_row").alias("row"),
                                               F.col("_to.t_col").alias("col"), "value")


EDGE_STEPS = 20  # a border is followed in this many steps an edge: its image is curved

#: Source offsets of each kernel from the floor of the position (nearest: from the rounded one).
REACH = {"nearest": (0,), "bilinear": (0, 1), "cubic": (-1, 0, 1, 2), "cubicspline": (-1, 0, 1, 2)}


def warp_grid(georef: DataFrame, src: int, dst: int) -> DataFrame:
    """Target grids of R5: ``(raster, x0, y0, dx, dy, n_rows, n_cols)`` in ``dst`` of rasters given likewise in ``src``.

    ``x0, y0`` is the upper left corner, rows go down.  The extent is that of the densified border, the cells are square and the
    diagonal keeps its number of cells.  One row a raster, no shuffle.
    """
    w, h = F.col("n_cols") * F.col("dx"), F.col("n_rows") * F.col("dy")
    steps = F.sequence(F.lit(0), F.lit(EDGE_STEPS))
    along = lambda i, size: size * i / EDGE_STEPS
    edge = lambda x, y: F.transform(steps, lambda i: F.struct(
        (F.col("x0") + x(i)).alias("x"), (F.col("y0") - y(i)).alias("y")))
    zero = lambda i: F.lit(0.0)
    border = F.concat(edge(lambda i: along(i, w), zero), edge(lambda i: along(i, w), lambda i: h),
                      edge(zero, lambda i: along(i, h)), edge(lambda i: w, lambda i: along(i, h)))
    g = georef.select("raster", "n_rows", "n_cols", transform_points(border, src, dst).alias("b"))
    part = lambda f, axis: f(F.transform("b", lambda p: p[axis]))
    g = g.select("raster", "n_rows", "n_cols", part(F.array_min, "x").alias("x0"), part(F.array_max, "x").alias("x1"),
                 part(F.array_min, "y").alias("y1"), part(F.array_max, "y").alias("y0"))
    w, h, rows, cols = F.col("x1") - F.col("x0"), F.col("y0") - F.col("y1"), F.col("n_rows"), F.col("n_cols")
    g = g.select("raster", "x0", "y0", w.alias("w"), h.alias("h"), (F.sqrt(w * w + h * h) / F.sqrt((rows * rows + cols * cols).cast("double"))).alias("dx"))
    count = lambda size: F.greatest(F.floor(F.col(size) / F.col("dx") + 0.5), F.lit(1)).cast("long")
    return g.select("raster", "x0", "y0", "dx", F.col("dx").alias("dy"), count("h").alias("n_rows"), count("w").alias("n_cols"))


def _weights(kind: str, d: np.ndarray) -> np.ndarray:
    a = np.abs(d)
    if kind == "nearest":
        return np.ones_like(a)
    if kind == "bilinear":
        return np.maximum(1 - a, 0)
    if kind == "cubic":  # Keys, a = -0.5
        return np.where(a <= 1, (1.5 * a - 2.5) * a * a + 1, np.where(a < 2, ((2.5 - 0.5 * a) * a - 4) * a + 2, 0))
    return np.where(a <= 1, 2 / 3 + (a / 2 - 1) * a * a, np.where(a < 2, (2 - a) ** 3 / 6, 0))


def _resample_block(kind: str, size: int):
    """Values of one block's target cells from its source pixels, a halo of two around them included."""
    reach = REACH[kind]

    def block(cells: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cells) and len(pixels):
            r0, c0 = int(cells["b_row"].iloc[0]) * size - 2, int(cells["b_col"].iloc[0]) * size - 2
            sr, sc = cells["sr"].to_numpy(), cells["sc"].to_numpy()
            shift = 0.5 if kind == "nearest" else 0.0
            br, bc = np.floor(sr + shift), np.floor(sc + shift)
            for band, px in pixels.groupby("band", sort=True):
                values = np.full((size + 5, size + 5), np.nan)
                values[px["row"].to_numpy() - r0, px["col"].to_numpy() - c0] = px["value"].to_numpy()
                total, weight = np.zeros(len(cells)), np.zeros(len(cells))
                for i in reach:
                    for j in reach:
                        v = values[(br + i - r0).astype(int), (bc + j - c0).astype(int)]
                        w = np.where(np.isnan(v), 0.0, _weights(kind, br + i - sr) * _weights(kind, bc + j - sc))
                        total, weight = total + w * np.nan_to_num(v), weight + w
                some = weight != 0
                out.append((np.full(some.sum(), band), cells["t_row"].to_numpy()[some], cells["t_col"].to_numpy()[some],
                            total[some] / weight[some]))
        if not out:
            return pd.DataFrame({n: pd.Series(dtype=t) for n, t in (("raster", object), ("band", "int64"), ("row", "int64"), ("col", "int64"), ("value", "float64"))})
        bands, rows, cols, values = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"raster": [cells["raster"].iloc[0]] * len(rows), "band": bands, "row": rows, "col": cols, "value": values})

    return block


def warp_crs(pixels: DataFrame, georef: DataFrame, src: int, dst: int, resample: str = "cubicspline",
             block: int = 128) -> tuple[DataFrame, DataFrame]:
    """Rasters in another CRS → ``(pixels, georef)`` on the grids of :func:`warp_grid`.

    The centre of every target cell goes back to ``src`` and takes the weighted mean of the pixels around it: ``nearest``,
    ``bilinear``, ``cubic`` (Keys) or ``cubicspline``, the cubic B-spline as a plain kernel (it smooths: there is no
    prefilter).  Kernels are not widened, since the grid keeps the resolution.  NULL, NaN and absent pixels drop out of the mean; cells whose
    centre lies outside the source raster, or that no pixel reaches, are absent.  Rows of ``pixels`` that repeat a cell are not allowed.
    Target cells and pixels meet in blocks of ``block`` × ``block`` source pixels with a halo of two, so a pixel is shuffled
    1.06 times and a cell once; a task holds one block of all bands, whatever the raster's size.
    """
    if resample not in REACH:
        raise ValueError(f"unknown resampling {resample}")
    grid = warp_grid(georef, src, dst)
    source = georef.select("raster", *[F.col(c).alias("s_" + c) for c in ("x0", "y0", "dx", "dy", "n_rows", "n_cols")])
    index = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # by number: target rows are few bytes now and many cells later, so partitions must not be coalesced by their bytes
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = grid.join(source, "raster").withColumn("t_row", F.explode(index("n_rows"))).repartition(n, "raster", "t_row")
    centres = F.transform(index("n_cols"), lambda c: F.struct(
        (F.col("x0") + (c + 0.5) * F.col("dx")).alias("x"), (F.col("y0") - (F.col("t_row") + 0.5) * F.col("dy")).alias("y")))
    cells = rows.select("raster", *[c for c in source.columns if c != "raster"], "t_row",
                        F.posexplode(transform_points(centres, dst, src)).alias("t_col", "p"))
    sr, sc = (F.col("s_y0") - F.col("p.y")) / F.col("s_dy") - 0.5, (F.col("p.x") - F.col("s_x0")) / F.col("s_dx") - 0.5
    cells = cells.select("raster", "t_row", F.col("t_col").cast("long").alias("t_col"), sr.alias("sr"), sc.alias("sc"), "s_n_rows", "s_n_cols")
    inside = lambda at, n: (F.col(at) >= -0.5) & (F.col(at) < F.col(n) - 0.5)
    cells = cells.where(inside("sr", "s_n_rows") & inside("sc", "s_n_cols")).select(
        "raster", "t_row", "t_col", "sr", "sc", F.floor(F.col("sr") / block).alias("b_row"), F.floor(F.col("sc") / block).alias("b_col"))
    near = lambda at: F.explode(F.array_distinct(F.transform(
        F.array(*[F.lit(i) for i in (-2, 2)]), lambda i: F.floor((F.col(at) + i) / block))))
    px = (pixels.select(F.col("raster").alias("raster"), "band", "row", "col", F.col("value").cast("double").alias("value")).where(F.col("value").isNotNull())
          .withColumn("b_row", near("row")).withColumn("b_col", near("col")))
    key = ["raster", "b_row", "b_col"]
    kinds = dict(pixels.dtypes)
    out = cells.groupBy(*key).cogroup(px.groupBy(*key)).applyInPandas(
        _resample_block(resample, block), f"raster {kinds['raster']}, band {kinds['band']}, row long, col long, value double")
    return out, grid


def granule_index(pixels: DataFrame, granules: DataFrame) -> DataFrame:
    """R8 with time: one row per granule — ``granules(location, time, label, priority)`` with its pixel bounds.

    ``pixels(location, band, row, col, value)``; a granule without pixels has NULL bounds and is never read.
    """
    bounds = pixels.groupBy("location").agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"),
                                            F.min("col").alias("col_min"), F.max("col").alias("col_max"))
    return granules.select("location", "time", "label", "priority").join(bounds, "location", "left")


def mosaic_at(pixels: DataFrame, index: DataFrame, at=None, window: tuple[int, int, int, int] | None = None,
              since=None) -> DataFrame:
    """The layer at one instant: per cell the latest granule up to ``at`` that covers it (no instant: the latest of all).

    ``since`` leaves out granules before it; ``window`` is ``(row_min, row_max, col_min, col_max)``, ends included.  The index rows
    are chosen first by time and extent and only their granules' pixels are joined: with pixels stored by ``location``, other
    folders are not read.  Among granules of one time the higher priority wins, then the greater location.  NULL pixels do not
    cover.  Columns: ``band, row, col, value, location, time, label``.
    """
    chosen = index.where(F.col("row_min").isNotNull() & F.col("time").isNotNull())
    px = pixels.select("location", "band", "row", "col", "value").where(F.col("value").isNotNull())
    if at is not None:
        chosen = chosen.where(F.col("time") <= F.lit(at))
    if since is not None:
        chosen = chosen.where(F.col("time") >= F.lit(since))
    if window is not None:
        r0, r1, c0, c1 = window
        chosen = chosen.where((F.col("row_max") >= r0) & (F.col("row_min") <= r1) & (F.col("col_max") >= c0) & (F.col("col_min") <= c1))
        px = px.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    hit = px.join(chosen.select("location", "time", "label", "priority"), "location")
    best = hit.groupBy("band", "row", "col").agg(F.max(F.struct("time", "priority", "location", "label", "value")).alias("b"))
    return best.select("band", "row", "col", "b.value", "b.location", "b.time", "b.label")


def mosaic(rasters: Sequence[tuple[DataFrame, int, str]]) -> tuple[DataFrame, DataFrame]:
    """Many rasters → one layer.  Each input is ``(pixels, priority, location)``; where
    footprints overlap the highest priority wins, and among equal ones the greatest location.  Returns ``(pixels, index)`` where the
    index has one row per input: location, footprint (row/col bounds), priority."""
    tagged = [p.withColumn("_prio", F.lit(prio)).withColumn("location", F.lit(loc)) for p, prio, loc in rasters]
    u = reduce(lambda a, b: a.unionByName(b), tagged)
    best = u.groupBy("band", "row", "col").agg(F.max(F.struct("_prio", "location", "value")).alias("_b"))
    px = best.select("band", "row", "col", F.col("_b.value").alias("value"), F.col("_b.location").alias("location"))
    index = u.groupBy("location").agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"),
                                      F.min("col").alias("col_min"), F.max("col").alias("col_max"),
                                      F.max("_prio").alias("priority"))
    return px, index
