import heapq

from pyspark.sql import functions as F

from geoweave.operators import network as N
from geoweave.sources.osm import read_osm
from tests.conftest import SF_SMALL, rows

OSM = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6">
  <node id="1" lat="51.0" lon="0.0"/>
  <node id="2" lat="51.0" lon="0.01"/>
  <node id="3" lat="51.0" lon="0.02"/>
  <node id="4" lat="50.99" lon="0.01"/>
  <node id="5" lat="51.01" lon="0.01"><tag k="amenity" v="cafe"/></node>
  <way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/></way>
  <way id="11"><nd ref="4"/><nd ref="2"/><nd ref="5"/><tag k="highway" v="residential"/></way>
</osm>
"""


def test_two_crossing_ways(spark, tmp_path):  # FIXTURES §8: 4 edges, 5 vertices, 1 POI
    f = tmp_path / "map.osm"
    f.write_text(OSM)
    nodes, ways, way_nodes = read_osm(spark, str(f))
    edges = N.build_ways(way_nodes, nodes)
    assert edges.count() == 4
    assert N.build_vertices(edges).count() == 5
    assert rows(N.points_of_interest(nodes).select("node_id")) == [(5,)]
    cfg = spark.createDataFrame([("primary", 1, 80.0)], "value string, class_id int, speed double")
    assert rows(N.osm_filter(ways, cfg), "way_id") == [(10,)]
    d = dict(rows(N.shortest_paths(edges, spark.createDataFrame([(1,)], "s long")).select("node", "d")))
    assert d[1] == 0.0 and d[5] > d[2] > 0


def test_shortest_paths_against_dijkstra(spark):
    from geoweave.plans import network as NP

    e = N.build_ways(NP.way_nodes(spark, SF_SMALL), NP.nodes(spark, SF_SMALL)).cache()
    adj = {}
    for r in e.select("source", "target", "length_m").collect():
        for a, b in ((r[0], r[1]), (r[1], r[0])):
            adj.setdefault(a, {})
            adj[a][b] = min(adj[a].get(b, float("inf")), r[2])
    src = min(adj)
    dist, pq = {src: 0.0}, [(0.0, src)]
    while pq:
        d, u = heapq.heappop(pq)
        if d > dist.get(u, float("inf")):
            continue
        for v, w in adj[u].items():
            if d + w < dist.get(v, float("inf")):
                dist[v] = d + w
                heapq.heappush(pq, (d + w, v))
    got = dict(rows(N.shortest_paths(e, spark.createDataFrame([(src,)], "s long")).select("node", "d")))
    assert set(got) == set(dist)
    assert all(abs(got[k] - dist[k]) < 1e-6 for k in dist)


def _distances(spark, edges, sources):
    e = spark.createDataFrame(edges, "source long, target long, length_m double")
    s = spark.createDataFrame([(x,) for x in sources], "s long")
    return {(r.src, r.node): r.d for r in N.shortest_paths(e, s).collect()}


def _dijkstra(edges, source):
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    dist, pq = {source: 0.0}, [(0.0, source)]
    while pq:
        d, u = heapq.heappop(pq)
        if d > dist[u]:
            continue
        for v, w in adj.get(u, []):
            if d + w < dist.get(v, float("inf")):
                dist[v] = d + w
                heapq.heappush(pq, (d + w, v))
    return dist


def test_chains_rings_and_loops(spark):
    """Long chains, parallel edges, a loop, a lollipop, a ring with a source and one that nothing reaches."""
    chain = [(i, i + 1, 1.0 + i % 3) for i in range(40)] + [(0, 100, 2.0), (100, 40, 500.0), (20, 200, 1.0), (20, 201, 1.0)]
    lollipop = [(40, 300, 1.0), (300, 301, 1.0), (301, 302, 5.0), (302, 40, 1.0), (40, 40, 3.0), (0, 1, 0.5)]
    rings = [(500 + i, 500 + (i + 1) % 7, 1.0) for i in range(7)] + [(600 + i, 600 + (i + 1) % 5, 1.0) for i in range(5)]
    edges, sources = chain + lollipop + rings, [7, 200, 503]
    got = _distances(spark, edges, sources)
    want = {(s, n): d for s in sources for n, d in _dijkstra(edges, s).items()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_long_road_takes_few_rounds(spark, monkeypatch):
    cuts = []
    cut = N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    n = 20_000
    e = spark.range(n).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(1.0).alias("length_m"))
    d = N.shortest_paths(e, spark.createDataFrame([(0,)], "s long"))
    assert d.where("d = node").count() == n + 1 and len(cuts) < 30
