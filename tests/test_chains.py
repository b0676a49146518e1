"""N6 in rounds that take nodes out of chains: distances against Dijkstra on awkward graphs, and what is stored on the way."""

import os
import random

import pytest
from pyspark.sql import functions as F
from tests.test_network import _dijkstra

from geoweave.operators import network as N
from geoweave.session import ensure_checkpoint_dir


def awkward(seed):
    """Roads of many nodes between junctions, parallel and zero-length ones, loops, lollipops, rings with and without a way in."""
    draw, edges, fresh = random.Random(seed), [], iter(range(100, 10_000))
    length = lambda: draw.choice([0.0, 0.5, 1.0, draw.random() * 9])

    def road(a, b, n):
        stops = [a, *[next(fresh) for _ in range(n)], b]
        edges.extend((x, y, length()) if draw.random() < 0.5 else (y, x, length()) for x, y in zip(stops, stops[1:]))
        return stops

    for _ in range(14):
        road(draw.randrange(8), draw.randrange(8), draw.choice([0, 0, 1, 2, 5, 30]))  # also from a junction to itself
    dead = road(0, next(fresh), 12)
    for n in (1, 2, 3, 4, 9):
        ring = next(fresh)
        road(ring, ring, n)
    inside = next(fresh)
    road(inside, inside, 7)
    edges += [(3, 3, 1.0), (0, 1, 5.0), (1, 0, 2.0)]
    draw.shuffle(edges)
    return edges, [0, 7, dead[5], inside, 99_999]  # sources inside a chain and a ring, and one that no edge has


@pytest.mark.parametrize(("seed", "rows"), [(0, 0), (1, 20), (2, 100_000)])
def test_distances_in_rounds(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(N, "CHAIN_ROWS", rows, raising=False)
    edges, sources = awkward(seed)
    e = spark.createDataFrame(edges, "source long, target long, length_m double")
    got = [(r.src, r.node, r.d) for r in N.shortest_paths(e, spark.createDataFrame([(x,) for x in sources], "s long")).collect()]
    want = {(s, n): d for s in sources for n, d in _dijkstra(edges, s).items()}
    assert len(got) == len(want) and {x[:2] for x in got} == set(want)
    assert all(d == pytest.approx(want[s, n], abs=1e-9) for s, n, d in got)


@pytest.mark.parametrize("rows", [10, 100_000])
def test_text_ids_unknown_lengths_and_mixed_widths(spark, monkeypatch, rows):
    monkeypatch.setattr(N, "CHAIN_ROWS", rows, raising=False)
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    road = spark.range(60).select(name(F.col("id")).alias("source"), name(F.col("id") + 1).alias("target"), F.lit(1.0).alias("length_m"))
    got = {r.node: r.d for r in N.shortest_paths(road, spark.createDataFrame([("n0",)], "s string")).collect()}
    assert got == {f"n{i}": float(i) for i in range(61)}
    # 20 and 21 are joined by an edge of unknown length, the road goes on to a second way in
    gap = spark.range(40).select(F.col("id").cast("int").alias("source"), (F.col("id") + 1).alias("target"), F.when(F.col("id") != 20, 1.0).alias("length_m"))
    paths = N.shortest_paths(gap.unionByName(spark.createDataFrame([(0, 40, 5.0), (None, 3, 1.0)], "source int, target long, length_m double")), spark.createDataFrame([(0,)], "s int"))
    assert dict(paths.dtypes)["node"] == "bigint"
    assert {r.node: r.d for r in paths.collect()} == {i: float(i) if i <= 20 else 45.0 - i for i in range(41)}


def test_a_road_leaves_little_behind(spark, monkeypatch):
    """What rounds store shrinks with what is left, and goes once the next round has it."""
    monkeypatch.setattr(N, "CHAIN_ROWS", 200, raising=False)
    at = ensure_checkpoint_dir(spark).removeprefix("file:")
    before, n = set(os.listdir(at)), 5_000
    road = spark.range(n).select(F.xxhash64("id").alias("source"), F.xxhash64(F.col("id") + 1).alias("target"), F.lit(1.0).alias("length_m"))
    d = N.shortest_paths(road, spark.range(1).select(F.xxhash64("id").alias("s")))
    assert sorted(r.d for r in d.collect()) == [float(i) for i in range(n + 1)]
    left = [x for x in set(os.listdir(at)) - before if x.startswith("kept-")]
    assert sum(spark.read.parquet(os.path.join(at, x)).count() for x in left) < 1.5 * n


def test_a_hub_of_many_chains(spark, monkeypatch):
    monkeypatch.setattr(N, "CHAIN_ROWS", 10, raising=False)
    spokes = spark.range(300).select(F.lit(0).cast("long").alias("source"), (F.col("id") + 1).alias("target"), F.lit(1.0).alias("length_m"))
    rims = spark.range(300).select((F.col("id") + 1).alias("source"), (F.col("id") + 1001).alias("target"), F.lit(2.0).alias("length_m"))
    d = N.shortest_paths(spokes.unionByName(rims), spark.createDataFrame([(0,)], "s long"))
    assert sorted(r.d for r in d.collect()) == [0.0] + [1.0] * 300 + [3.0] * 300
