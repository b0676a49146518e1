"""Rasters in another CRS: closed formulas on polynomial surfaces, kernels against each other, missing pixels, many blocks."""

import math

import pytest

from geoweave.functions.crs import R_MERC
from geoweave.operators import raster as RS

GEOREF = "raster string, x0 double, y0 double, dx double, dy double, n_rows long, n_cols long"


def _surface(spark, f, rows, cols, skip=()):
    data = [("r", b, r, c, f(r, c) * b) for b in (1, 2) for r in range(rows) for c in range(cols) if (r, c) not in skip]
    return spark.createDataFrame(data, "raster string, band int, row long, col long, value double")


def _cells(df):
    return {(r.band, r.row, r.col): r.value for r in df.collect()}


@pytest.mark.parametrize("block", [8, 128])
def test_quadratic_surface_from_mercator(spark, block):
    """A cubic B-spline adds a third of the second derivative's half to a quadratic: r² becomes r² + 1/3."""
    rows, cols, x0, y0, d = 30, 20, 100000.0, 6_700_000.0, 1000.0
    f = lambda r, c: r * r + 2.0 * c + r * c
    geo = spark.createDataFrame([("r", x0, y0, d, d, rows, cols)], GEOREF)
    out, grid = RS.warp_crs(_surface(spark, f, rows, cols), geo, 3857, 4326, block=block)
    g, got = grid.first(), _cells(out)
    n = 0
    for r in range(g.n_rows):
        for c in range(g.n_cols):
            lon, lat = g.x0 + (c + 0.5) * g.dx, g.y0 - (r + 0.5) * g.dy
            sc = (R_MERC * math.radians(lon) - x0) / d - 0.5
            sr = (y0 - R_MERC * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))) / d - 0.5
            assert ((1, r, c) in got) == (-0.5 <= sr < rows - 0.5 and -0.5 <= sc < cols - 0.5)
            if 1 <= sr < rows - 2 and 1 <= sc < cols - 2:
                n += 1
                assert abs(got[1, r, c] - (f(sr, sc) + 1 / 3)) < 1e-6 and abs(got[2, r, c] - 2 * got[1, r, c]) < 1e-9
    assert n > 300


@pytest.mark.parametrize("kind", ["nearest", "bilinear", "cubic"])
def test_same_crs_keeps_the_pixels(spark, kind):
    f = lambda r, c: math.sin(r) + c
    geo = spark.createDataFrame([("r", 0.0, 50.0, 2.0, 2.0, 9, 7)], GEOREF)
    out, grid = RS.warp_crs(_surface(spark, f, 9, 7), geo, 4326, 4326, kind, block=4)
    got = _cells(out)
    assert len(got) == 2 * 63 and tuple(grid.first())[1:] == (0.0, 50.0, 2.0, 2.0, 9, 7)
    assert all(abs(v - b * f(r, c)) < 1e-9 for (b, r, c), v in got.items())


def test_missing_pixels_drop_out(spark):
    hole = {(r, c) for r in range(6, 12) for c in range(6, 12)}
    geo = spark.createDataFrame([("r", 0.0, 50.0, 1.0, 1.0, 16, 16), ("none", 0.0, 50.0, 1.0, 1.0, 4, 4)], GEOREF)
    got = _cells(RS.warp_crs(_surface(spark, lambda r, c: 5.0, 16, 16, hole), geo, 4326, 4326, block=5)[0])
    assert all(abs(v - 5.0 * b) < 1e-9 for (b, _r, _c), v in got.items())
    assert {(r, c) for b, r, c in got if b == 1} == {(r, c) for r in range(16) for c in range(16)} - {
        (r, c) for r in range(7, 11) for c in range(7, 11)}
    with pytest.raises(ValueError):
        RS.warp_crs(_surface(spark, lambda r, c: 1.0, 2, 2), geo, 4326, 4326, "lanczos")
