"""Union by grid cells against the overlay in one step, and one feature of many edges."""

import numpy as np
from pyspark.sql import functions as F

from geoweave.functions import geom as G
from geoweave.operators.union import large_union, make_valid, overlay, union_agg


def area(parts):
    total = 0.0
    for part in parts:
        for ring in part:
            r = np.asarray(ring)
            total += float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2
    return total


def summary(parts, overlap):
    return round(area(parts), 5), len(parts), sorted(len(p) - 1 for p in parts), sum(len(r) for p in parts for r in p), overlap


def random_faces(seed):
    rng = np.random.default_rng(seed)
    faces = []
    for _ in range(14):
        c, n = rng.uniform(0, 10, 2), int(rng.integers(3, 7))
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        faces.append([(c + rng.uniform(0.5, 3) * np.c_[np.cos(turn), np.sin(turn)]).tolist()])
    x = rng.integers(0, 8, (6, 2)).astype(float).tolist()
    faces += [[[[a, b], [a + 2, b], [a + 2, b + 2], [a, b + 2]]] for a, b in x]
    faces += [[[[20, 0], [22, 2], [22, 0], [20, 2]]], faces[0], [[[30, 0], [36, 0], [36, 6], [30, 6]], [[32, 2], [34, 2], [34, 4], [32, 4]]]]
    return [[[[float(v) for v in xy] for xy in ring] for ring in part] for part in faces]


def test_grid_cells_equal_the_overlay(spark):
    rows = [(k, part) for k in range(6) for part in random_faces(k)]
    df = spark.createDataFrame(rows, "_k int, part array<array<array<double>>>")
    want = {k: overlay(random_faces(k)) for k in range(6)}
    got = {r._k: r for r in large_union(df, per_cell=6).collect()}
    assert sorted(got) == sorted(want)
    for k, (parts, overlap) in want.items():
        assert summary(got[k].parts, got[k].overlap_edges) == summary(parts, overlap), k


def test_union_agg_takes_both_ways(spark):
    x, y = F.col("id") % 30, F.floor(F.col("id") / 30)
    df = spark.range(900).select(F.lit("all").alias("k"), G.box(x.cast("double"), y.cast("double"), (x + 1.5).cast("double"), (y + 1).cast("double")).alias("geom"))
    one, many = (union_agg(df, "k", small=n).select(F.round(G.st_area("geom"), 6).alias("a"), F.size(F.col("geom")["parts"]).alias("n"),
                                                    "overlap_edges").collect() for n in (10**6, 100))
    assert one == many and one[0].a == 30.5 * 30


def test_make_valid(spark):
    rings = {"bow": [[[0, 0], [2, 2], [2, 0], [0, 2]]], "eight": [[[0, 0], [4, 0], [4, 4], [2, 4], [2, -2], [0, -2]]],
             "hole": [[[0, 0], [4, 0], [4, 4], [0, 4]], [[3, 1], [6, 1], [6, 3], [3, 3]]], "spike": [[[0, 0], [5, 5], [0, 0]]]}
    rows = [(k, "POLYGON", [[[float(x), float(y)] for x, y in [*r, r[0]]] for r in v]) for k, v in rings.items()]
    vertex = F.transform("r", lambda ring: F.transform(ring, lambda v: G.vertex(v[0], v[1])))
    df = spark.createDataFrame(rows, "k string, t string, r array<array<array<double>>>").select(
        "k", G.make_geom(F.col("t"), F.array(vertex)).alias("geom")).unionByName(
        spark.range(1).select(F.lit("point").alias("k"), G.point(F.lit(1.0), F.lit(2.0)).alias("geom")))
    got = {r.k: (r.t, r.a, r.n) for r in make_valid(df, "k").select("k", F.col("geom")["type"].alias("t"), F.round(G.st_area("geom"), 6).alias("a"),
                                                                   F.size(F.col("geom")["parts"]).alias("n")).collect()}
    assert got == {"bow": ("MULTIPOLYGON", 2.0, 2), "eight": ("MULTIPOLYGON", 12.0, 2), "hole": ("MULTIPOLYGON", 18.0, 2),
                   "spike": ("MULTIPOLYGON", 0.0, 0), "point": ("POINT", 0.0, 1)}
