"""Closed-form coordinate transforms (S12 / G12) as Column math.

Supported: EPSG:4326 ⇄ 3857 (web Mercator), 4326 → 4978 (geocentric), 4326 ⇄
UTM north (326xx WGS84, 258xx ETRS89 ≈ WGS84), 4326 ⇄ 27700 (British National
Grid: 7-parameter Helmert to OSGB36, then transverse Mercator on Airy 1830;
~metre accuracy), and any pair of these through 4326.  Unknown codes raise.

A transform is a list of *stages*; each stage maps the named values of the
previous one to new named values.  On Spark every stage is one ``transform``
over a ring's vertices producing a struct, so an intermediate (latitude in the
iterative datum inverse, ν/ρ in the projection series) is computed once and
referenced by name — a single nested expression would duplicate it
exponentially.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions.util import as_col

# Ellipsoids (semi-major axis a, inverse flattening) and projection parameters (public EPSG data).
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)
AIRY1830 = (6377563.396, 299.3249646)
# British National Grid: scale, origin lat/lon (degrees), false easting/northing.
BNG = dict(k0=0.9996012717, lat0=49.0, lon0=-2.0, fe=400000.0, fn=-100000.0)
# WGS84 → OSGB36 Helmert: tx, ty, tz (m), scale (ppm), rx, ry, rz (arc-seconds).
HELMERT_WGS84_OSGB36 = (-446.448, 125.157, -542.060, 20.4894, -0.1502, -0.2470, -0.8421)
R_MERC = 6378137.0


class SparkMath:
    sin, cos, tan, sqrt, atan, atan2, ln, exp, radians, degrees = (
        F.sin, F.cos, F.tan, F.sqrt, F.atan, F.atan2, F.log, F.exp, F.radians, F.degrees)
    pi = math.pi


Stage = Callable[[Callable[[str], object], type], dict]


# --- stages (v(name) reads the previous stage, m is the math namespace) ----------------------

def _merc_fwd(v, m):
    return {"x": R_MERC * m.radians(v("x")), "y": R_MERC * m.ln(m.tan(m.pi / 4 + m.radians(v("y")) / 2)), "z": v("z")}


def _merc_inv(v, m):
    return {"x": m.degrees(v("x") / R_MERC), "y": m.degrees(2 * m.atan(m.exp(v("y") / R_MERC)) - m.pi / 2), "z": v("z")}


def _ecef_stages(ell=WGS84) -> list[Stage]:
    a, invf = ell
    f = 1 / invf
    e2 = f * (2 - f)

    def s1(v, m):
        return {"phi": m.radians(v("y")), "lam": m.radians(v("x")), "h": v("z")}

    def s2(v, m):
        return {"phi": v("phi"), "lam": v("lam"), "h": v("h"),
                "n": a / m.sqrt(1 - e2 * m.sin(v("phi")) * m.sin(v("phi")))}

    def s3(v, m):
        nh = v("n") + v("h")
        return {"x": nh * m.cos(v("phi")) * m.cos(v("lam")), "y": nh * m.cos(v("phi")) * m.sin(v("lam")),
                "z": (v("n") * (1 - e2) + v("h")) * m.sin(v("phi"))}
    return [s1, s2, s3]


def _helmert_stage(params) -> Stage:
    tx, ty, tz, s_ppm, rx, ry, rz = params
    s = 1 + s_ppm * 1e-6
    r = math.pi / (180 * 3600)
    rx, ry, rz = rx * r, ry * r, rz * r

    def st(v, m):
        x, y, z = v("x"), v("y"), v("z")
        return {"x": tx + s * x - rz * y + ry * z, "y": ty + rz * x + s * y - rx * z, "z": tz - ry * x + rx * y + s * z}
    return st


def _geodetic_stages(ell, iterations: int = 4) -> list[Stage]:
    """ECEF → (lon, lat) by fixed-point iteration on latitude (each round one stage)."""
    a, invf = ell
    f = 1 / invf
    e2 = f * (2 - f)

    def init(v, m):
        p = m.sqrt(v("x") * v("x") + v("y") * v("y"))
        return {"x": v("x"), "y": v("y"), "z": v("z"), "p": p, "phi": m.atan2(v("z"), p * (1 - e2))}

    def step(v, m):
        sphi = m.sin(v("phi"))
        n = a / m.sqrt(1 - e2 * sphi * sphi)
        return {"x": v("x"), "y": v("y"), "z": v("z"), "p": v("p"), "phi": m.atan2(v("z") + e2 * n * sphi, v("p"))}

    def done(v, m):
        return {"x": m.degrees(m.atan2(v("y"), v("x"))), "y": m.degrees(v("phi")), "z": v("z0")}

    return [init] + [step] * iterations + [done]


def _tm_stages(ell, k0, lat0, lon0, fe, fn) -> list[Stage]:
    """Transverse Mercator (Redfearn series, as in the Ordnance Survey guide), in three stages."""
    a, invf = ell
    b = a * (1 - 1 / invf)
    e2 = (a * a - b * b) / (a * a)
    n = (a - b) / (a + b)
    phi0, lam0 = math.radians(lat0), math.radians(lon0)

    def s1(v, m):
        phi = m.radians(v("y"))
        return {"phi": phi, "dl": m.radians(v("x")) - lam0, "s": m.sin(phi), "c": m.cos(phi), "t": m.tan(phi), "z": v("z")}

    def s2(v, m):
        s, c, t, phi = v("s"), v("c"), v("t"), v("phi")
        w = 1 - e2 * s * s
        nu = a * k0 / m.sqrt(w)
        rho = a * k0 * (1 - e2) / (w * m.sqrt(w))
        dp, sp = phi - phi0, phi + phi0
        mm = b * k0 * ((1 + n + 1.25 * n ** 2 + 1.25 * n ** 3) * dp
                       - (3 * n + 3 * n ** 2 + 2.625 * n ** 3) * m.sin(dp) * m.cos(sp)
                       + (1.875 * n ** 2 + 1.875 * n ** 3) * m.sin(2 * dp) * m.cos(2 * sp)
                       - (35.0 / 24.0) * n ** 3 * m.sin(3 * dp) * m.cos(3 * sp))
        return {"s": s, "c": c, "t2": t * t, "nu": nu, "rho": rho, "mm": mm, "dl": v("dl"), "z": v("z")}

    def s3(v, m):
        s, c, t2, nu, rho, dl = v("s"), v("c"), v("t2"), v("nu"), v("rho"), v("dl")
        eta2 = nu / rho - 1
        c3 = c * c * c
        c5 = c3 * c * c
        i2 = nu / 2 * s * c
        i3 = nu / 24 * s * c3 * (5 - t2 + 9 * eta2)
        i3a = nu / 720 * s * c5 * (61 - 58 * t2 + t2 * t2)
        i4 = nu * c
        i5 = nu / 6 * c3 * (nu / rho - t2)
        i6 = nu / 120 * c5 * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2)
        dl2 = dl * dl
        return {"x": fe + i4 * dl + i5 * dl2 * dl + i6 * dl2 * dl2 * dl,
                "y": v("mm") + fn + i2 * dl2 + i3 * dl2 * dl2 + i3a * dl2 * dl2 * dl2, "z": v("z")}
    return [s1, s2, s3]


def _tm_inverse_stages(ell, k0, lat0, lon0, fe, fn, iterations: int = 6) -> list[Stage]:
    """Easting / northing → (lon, lat): footpoint latitude by iteration on the meridian arc, then the inverse series."""
    a, invf = ell
    b = a * (1 - 1 / invf)
    e2 = (a * a - b * b) / (a * a)
    n = (a - b) / (a + b)
    phi0 = math.radians(lat0)

    def arc(phi, m):
        dp, sp = phi - phi0, phi + phi0
        return b * k0 * ((1 + n + 1.25 * n ** 2 + 1.25 * n ** 3) * dp - (3 * n + 3 * n ** 2 + 2.625 * n ** 3) * m.sin(dp) * m.cos(sp)
                         + (1.875 * n ** 2 + 1.875 * n ** 3) * m.sin(2 * dp) * m.cos(2 * sp)
                         - (35.0 / 24.0) * n ** 3 * m.sin(3 * dp) * m.cos(3 * sp))

    def init(v, m):
        return {"north": v("y") - fn, "east": v("x") - fe, "phi": (v("y") - fn) / (a * k0) + phi0, "z": v("z")}

    def step(v, m):
        return {"north": v("north"), "east": v("east"), "phi": v("phi") + (v("north") - arc(v("phi"), m)) / (a * k0), "z": v("z")}

    def local(v, m):
        s, t = m.sin(v("phi")), m.tan(v("phi"))
        w = 1 - e2 * s * s
        return {"phi": v("phi"), "d": v("east"), "t": t, "sec": 1 / m.cos(v("phi")), "nu": a * k0 / m.sqrt(w),
                "rho": a * k0 * (1 - e2) / (w * m.sqrt(w)), "z": v("z")}

    def scaled(v, m):
        u = v("d") / v("nu")
        return {"phi": v("phi"), "t": v("t"), "t2": v("t") * v("t"), "sec": v("sec"), "u": u, "u2": u * u,
                "ratio": v("nu") / v("rho"), "z": v("z")}

    def done(v, m):
        t2, u2, q = v("t2"), v("u2"), v("ratio")
        eta2 = q - 1
        north = v("t") * q * u2 / 2 * (1 - u2 / 12 * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) + u2 * u2 / 360 * (61 + 90 * t2 + 45 * t2 * t2))
        east = v("sec") * v("u") * (1 - u2 / 6 * (q + 2 * t2) + u2 * u2 / 120 * (5 + 28 * t2 + 24 * t2 * t2)
                                    - u2 * u2 * u2 / 5040 * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2))
        return {"x": lon0 + m.degrees(east), "y": m.degrees(v("phi") - north), "z": v("z")}

    return [init] + [step] * iterations + [local, scaled, done]


def _utm(code: int) -> tuple | None:
    """Ellipsoid and projection parameters of a northern UTM code (326xx WGS84, 258xx ETRS89), else None."""
    if 32601 <= code <= 32660 or 25828 <= code <= 25838:
        zone = code - 32600 if code > 32600 else code - 25800
        return WGS84 if code > 32600 else GRS80, 0.9996, 0.0, -183.0 + 6 * zone, 500000.0, 0.0
    return None


def _keep_z(stage: Stage) -> Stage:
    """Carry the original z (as ``z0``) through stages that reuse ``z`` for geocentric values."""
    def st(v, m):
        out = stage(v, m)
        out["z0"] = v("z0")
        return out
    return st


def stages(src: int, dst: int) -> list[Stage]:
    """Stage list for ``src`` → ``dst`` (chosen on the driver; per-row work is arithmetic only)."""
    if src == dst:
        return []
    if src == 3857:
        return [_merc_inv] + stages(4326, dst)
    def lift(v, m):
        return {"x": v("x"), "y": v("y"), "z": 0.0 * v("x"), "z0": v("z")}

    if src == 27700:
        ecef = [_keep_z(s) for s in _ecef_stages(AIRY1830)]
        geo = [_keep_z(s) for s in _geodetic_stages(WGS84)]
        back = _keep_z(_helmert_stage(tuple(-p for p in HELMERT_WGS84_OSGB36)))
        return [*_tm_inverse_stages(AIRY1830, **BNG), lift, *ecef, back, *geo, *stages(4326, dst)]
    if _utm(src):
        return _tm_inverse_stages(*_utm(src)) + stages(4326, dst)
    if src != 4326:
        raise ValueError(f"unsupported source CRS EPSG:{src}")
    if dst == 3857:
        return [_merc_fwd]
    if dst == 4978:
        return _ecef_stages(WGS84)
    if _utm(dst):
        return _tm_stages(*_utm(dst))
    if dst == 27700:
        ecef = [_keep_z(s) for s in _ecef_stages(WGS84)]
        geo = [_keep_z(s) for s in _geodetic_stages(AIRY1830)]
        return [lift, *ecef, _keep_z(_helmert_stage(HELMERT_WGS84_OSGB36)), *geo, *_tm_stages(AIRY1830, **BNG)]
    raise ValueError(f"unsupported target CRS EPSG:{dst}")


# --- Spark side ----------------------------------------------------------------------------------

def _as_col(e) -> Column:
    return e if isinstance(e, Column) else F.lit(float(e))


def _ring_transform(ring: Column, sts: list[Stage]) -> Column:
    cur = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"),
                                               p["z"].alias("z0")))
    def apply(st: Stage):
        return lambda v: F.struct(*[_as_col(e).alias(k) for k, e in st(lambda n: v[n], SparkMath).items()])

    for st in sts:
        cur = F.transform(cur, apply(st))
    return F.transform(cur, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].cast("double").alias("z")))


def transform_points(points: Column, src: int, dst: int) -> Column:
    """An array of points ``(x, y)`` in another CRS, as ``(x, y, z)`` with z 0; stage by stage, nothing is computed twice."""
    flat = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("z")))
    return _ring_transform(flat, stages(src, dst))


def st_transform(geom, dst: int, src: int) -> Column:
    """Reproject every vertex from ``src`` to ``dst`` (z kept; 4978 uses z as height, NULL → 0)."""
    g = as_col(geom)
    sts = stages(src, dst)
    if dst == 4978:
        sts = [lambda v, m: {"x": v("x"), "y": v("y"), "z": F.coalesce(v("z"), F.lit(0.0)) if m is SparkMath else v("z"),
                             "z0": v("z0")}] + sts
    parts = F.transform(g["parts"], lambda part: F.transform(part, lambda ring: _ring_transform(ring, sts)))
    return g.withField("parts", parts).withField("srid", F.lit(dst).cast("int"))


def reproject_df(df, geom_col: str, dst: int, src: int | None = None):
    """S12 at DataFrame level: with ``src`` it is the label form (T16); otherwise the distinct
    SRIDs present are read (one row per CRS) and every row takes its own SRID's branch in a single scan."""
    if src is not None:
        return df.withColumn(geom_col, st_transform(F.col(geom_col), dst, src))
    srids = [r[0] for r in df.select(F.col(geom_col)["srid"]).distinct().collect()]
    if None in srids:
        raise ValueError("geometries without SRID: give src")
    out = F.col(geom_col)
    for s in sorted(srids):
        out = F.when(F.col(geom_col)["srid"] == s, st_transform(geom_col, dst, s)).otherwise(out)
    return df.withColumn(geom_col, out)
