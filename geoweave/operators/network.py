"""Road network from OSM-shaped tables.

Inputs: ``nodes(node_id, lon, lat, tags)`` and ``way_nodes(way_id, pos, node_id)``
(+ ``ways(way_id, tags)``).  Outputs follow the routing schema: ``ways`` edges
``(edge_id, way_id, source, target, length_m, n_points)``, ``vertices(id, degree)``
and ``pointsofinterest``.  Splitting uses a running sum over each way's node
sequence (window partitioned by way — bounded by the way's length); vertex
detection is a partial aggregate per node, so a node shared by a huge number
of ways is still counted map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweave.session import cut_lineage, freed, kept, opened, shuffled, stored, tasks_for, tasks_of

EARTH_R = 6371008.8  # mean Earth radius (m)


def osm_filter(ways: DataFrame, config: DataFrame, tag_key: str = "highway") -> DataFrame:
    """Keep ways whose ``tag_key`` value is in the class config ``(value, class_id, speed)``."""
    t = ways.select("way_id", F.explode("tags").alias("t")).where(F.col("t._k") == tag_key)
    t = t.select("way_id", F.col("t._v").alias("value"))
    return t.join(config, "value")


def haversine(lon1, lat1, lon2, lat2):
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi, dl = p2 - p1, F.radians(lon2) - F.radians(lon1)
    a = F.sin(dphi / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) ** 2
    return 2 * EARTH_R * F.asin(F.sqrt(a))


def build_ways(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Split ways at shared nodes → edges with source, target, length (haversine) and point count.

    Two shuffle stages: everything keyed by node (use count, coordinates) first,
    then one way-keyed stage in which every window (renumbering, end flags,
    running segment id, previous point) shares the same partitioning.  A vertex
    closes one segment and opens the next, so each node row emits its segment
    memberships with ``explode`` in a single pass (no union of two branches).
    ``wkt`` is the edge's line.  Nodes without coordinates leave the line; :func:`missing_nodes` lists them.
    """
    wn = way_nodes.select("way_id", "pos", "node_id")
    shared = wn.groupBy("node_id").agg((F.count(F.lit(1)) >= 2).alias("_shared"))
    geo = wn.join(shared, "node_id").join(nodes.select("node_id", "lon", "lat"), "node_id")
    w = Window.partitionBy("way_id")
    geo = geo.repartition(tasks_for(wn), "way_id")  # a task sorts a bounded number of rows, however many there are
    # positions may repeat inside a way: order by (pos, node_id) and renumber
    geo = geo.withColumn("pos", F.row_number().over(w.orderBy("pos", "node_id")))
    geo = (geo.withColumn("_first", F.col("pos") == 1)
              .withColumn("_last", F.col("pos") == F.max("pos").over(w)))
    geo = geo.withColumn("is_vertex", F.col("_first") | F.col("_last") | F.col("_shared"))
    seg = geo.withColumn("_seg", F.sum(F.col("is_vertex").cast("int")).over(w.orderBy("pos")))
    member = F.array(F.when(~(F.col("_last") & F.col("is_vertex")), F.col("_seg")),
                     F.when(F.col("is_vertex") & ~F.col("_first"), F.col("_seg") - 1))
    pts = seg.select("way_id", "pos", "node_id", "lon", "lat", F.explode(member).alias("_s")).where(F.col("_s").isNotNull())
    wp = w.orderBy("_s", "pos")
    pts = (pts.withColumn("_prev_lon", F.lag("lon").over(wp)).withColumn("_prev_lat", F.lag("lat").over(wp))
              .withColumn("_prev_s", F.lag("_s").over(wp)))
    step = F.when(F.col("_prev_s") == F.col("_s"),
                  haversine(F.col("_prev_lon"), F.col("_prev_lat"), F.col("lon"), F.col("lat"))).otherwise(F.lit(0.0))
    edges = pts.withColumn("_d", step).groupBy("way_id", "_s").agg(
        F.min_by("node_id", "pos").alias("source"), F.max_by("node_id", "pos").alias("target"),
        F.sum("_d").alias("length_m"), F.count(F.lit(1)).alias("n_points"),
        F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("_line"))
    point = lambda x: F.concat_ws(" ", x["lon"].cast("string"), x["lat"].cast("string"))
    line = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("_line", point), ", "), F.lit(")"))
    edges = edges.where(F.col("n_points") >= 2)
    return edges.select(F.concat_ws("_", F.col("way_id").cast("string"), F.col("_s").cast("string")).alias("edge_id"),
                        "way_id", "source", "target", "length_m", "n_points", line.alias("wkt"))


def missing_nodes(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rejects of N2: way nodes without coordinates, ``(way_id, pos, node_id)``."""
    known = nodes.where("lon is not null and lat is not null").select("node_id")
    return way_nodes.select("way_id", "pos", "node_id").join(known, "node_id", "left_anti").select("way_id", "pos", "node_id")


def with_costs(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Routing columns of N2: ``classes(way_id, class_id, maxspeed_kmh, oneway)`` → class, direction and costs per edge.

    ``cost`` is the length and ``cost_s`` the seconds at the class speed; the reverse ones are -1 on one-way edges
    (``oneway`` = 'yes'; '-1' reverses the direction).  Edges of a way without a class have none of them.
    """
    seconds = F.col("length_m") / (F.col("maxspeed_kmh") / 3.6)
    shut, shut_back = (F.coalesce(F.col("oneway") == value, F.lit(False)) for value in ("-1", "yes"))
    known = F.col("class_id").isNotNull()
    cost = lambda closed, value: F.when(known, F.when(closed, F.lit(-1.0)).otherwise(value))
    return edges.join(classes, "way_id", "left").select(
        *edges.columns, "class_id", F.when(known, F.when(shut_back, 1).when(shut, -1).otherwise(2)).alias("one_way"),
        cost(shut, F.col("length_m")).alias("cost"), cost(shut_back, F.col("length_m")).alias("reverse_cost"),
        cost(shut, seconds).alias("cost_s"), cost(shut_back, seconds).alias("reverse_cost_s"))


def build_vertices(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct edge end points with their degree, and with ``nodes`` their position as WKT."""
    ends = edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id")))
    out = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    if nodes is None:
        return out
    where = nodes.select(F.col("node_id").alias("id"), F.concat(
        F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")).alias("wkt"))
    return out.join(where, "id", "left")


def points_of_interest(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes carrying tags (optionally only the given keys)."""
    t = nodes.select("node_id", "lon", "lat", F.explode("tags").alias("t"))
    if keys:
        t = t.where(F.col("t._k").isin(keys))
    return t.groupBy("node_id", "lon", "lat").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("t._k"), F.col("t._v"))))).alias("tags"))


def append_network(a: DataFrame, b: DataFrame, key: str = "way_id") -> DataFrame:
    """Multi-file append; all rows of ``a`` and those of ``b`` whose OSM id ``a`` does not have."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti").select(*a.columns))


#: Inner nodes of chains that are walked by one task; more are first made fewer in rounds.
CHAIN_ROWS = 100_000

#: An inner node of a chain: its neighbours, which side of theirs leads back (none if the neighbour stays) and the lengths.
CHAIN = ["x", "ln", "ls", "lw", "rn", "rs", "rw"]


def contract_chains(arcs: DataFrame, keep: DataFrame) -> tuple[str, DataFrame, list[str]]:
    """Chains of nodes with two neighbours as single arcs, by taking out nodes that do not touch.

    ``arcs(u, v, w)`` is symmetric, with one row a pair; loops and arcs without an end are left out, negative lengths refused.
    Nodes of ``keep`` (first column) never become inner ones.  Returns the folder of the arcs ``(u, v, w)`` between the nodes that
    stay, a frame with the columns of CHAIN, and folders of such rows, in the order in which nodes were taken out: each
    stands between neighbours that stay or were taken out later, so :func:`_expand` goes through them backwards.
    A round takes out the nodes whose hash is below their neighbours', about a third, and joins the neighbours to each
    other: one shuffle of what is left, so all rounds together shuffle and store a fixed multiple of the nodes.  The last CHAIN_ROWS are
    walked by one task.  Rings without a node that stays shrink to one node and are left out (nothing that stays reaches them).
    """
    spark = arcs.sparkSession
    stay = lambda name: shuffled(keep.select(F.col(keep.columns[0]).alias(name)).distinct().withColumn("_stays", F.lit(True)))
    real, own = F.col("u") != F.col("v"), Window.partitionBy("u")
    arcs = arcs.select("u", "v", "w", F.sum(real.cast("int")).over(own).alias("_n"), F.min(F.when(real, F.col("v"))).over(own).alias("_lo"))
    arcs = arcs.join(stay("u"), "u", "left")
    inner = (F.col("_n") == 2) & F.col("_stays").isNull()
    side = F.when(inner, F.when(F.col("v") == F.col("_lo"), 0).otherwise(1)).cast("tinyint")
    arcs = arcs.select("u", "v", "w", side.alias("side"))
    arcs_at = stored(arcs)
    arcs = opened(arcs, arcs_at)
    if not arcs.where("w < 0").isEmpty():
        freed(spark, arcs_at)
        raise ValueError("shortest paths need edge lengths of 0 or more")
    # each node hears from its neighbours which of their sides leads to it
    n, own = arcs.count(), Window.partitionBy("x")
    heard = arcs.where(real).select(F.col("v").alias("x"), F.struct(F.col("u").alias("n"), F.col("side").alias("s"), "w").alias("l"))
    heard = heard.repartition(tasks_of(spark, n), "x").join(stay("x"), "x", "left").select(
        "x", "l", F.lead("l").over(own.orderBy("l.n")).alias("r"), (F.col("_stays").isNull() & (F.count(F.lit(1)).over(own) == 2)).alias("inner"))
    heard = heard.where("inner AND r IS NOT NULL OR NOT inner AND l.s IS NULL").withColumn("r", F.when(F.col("inner"), F.col("r")))
    state = heard.select("x", *[F.col(f"{a}.{b}").alias(a + b) for a in "lr" for b in "nsw"])
    state_at = stored(state)
    freed(spark, arcs_at)
    state = opened(state, state_at)
    direct = state.where("rn IS NULL").select(F.col("x").alias("u"), F.col("ln").alias("v"), F.col("lw").alias("w"))
    direct_at = stored(direct)
    chains, gone = state.where("rn IS NOT NULL"), []
    n = chains.count()
    while n > CHAIN_ROWS:
        chains, state_at, taken = _take_out(chains, state_at, n, len(gone))
        gone.append(taken)
        n = chains.count()
    if n:
        gone.append(stored(chains.select(*CHAIN).repartition(1).mapInArrow(_walk, chains.select(*CHAIN).schema)))
    freed(spark, state_at)
    like = state.select(*CHAIN)
    if not gone:
        return direct_at, like, gone
    ends = opened(like, *gone).where("ls IS NULL AND rs IS NULL AND ln <> rn").select("ln", "rn", (F.col("lw") + F.col("rw")).alias("w"))
    both = F.inline(F.array(F.struct(F.col("ln").alias("u"), F.col("rn").alias("v"), "w"), F.struct(F.col("rn").alias("u"), F.col("ln").alias("v"), "w")))
    whole_at = stored(opened(direct, direct_at).unionByName(ends.select(both)).groupBy("u", "v").agg(F.min("w").alias("w")))
    freed(spark, direct_at)
    return whole_at, like, gone


def _take_out(chains: DataFrame, at: str, n: int, rnd: int) -> tuple[DataFrame, str, str]:
    """One round of :func:`contract_chains`: ``n`` rows ``chains``, read from ``at``, without the nodes taken out; both are stored anew."""
    spark = chains.sparkSession
    key = lambda c: F.struct(F.xxhash64(c, F.lit(rnd)), F.col(c))
    lowest = (F.col("ls").isNull() | (key("x") < key("ln"))) & (F.col("rs").isNull() | (key("x") < key("rn")))
    chains = chains.where("ls IS NULL OR ln <> x").select(*CHAIN)  # a ring's last node touches itself
    taken = stored(chains.where(lowest))
    told = F.inline(F.array(*[F.struct(F.col(a + "n").alias("x"), F.col(a + "s").alias("to"), F.col(b + "n").alias("n"), F.col(b + "s").alias("s"),
                                       (F.col("lw") + F.col("rw")).alias("w")) for a, b in ("lr", "rl")]))
    told = opened(chains, taken).select(told).where("to IS NOT NULL")
    told = told.select("x", *[F.when(F.col("to") == k, F.col(c)).alias(a + c) for k, a in enumerate("lr") for c in "nsw"], F.lit(True).alias("told"))
    rest = chains.where(~lowest).withColumn("told", F.lit(False)).unionByName(told)
    if (tasks := tasks_of(spark, n + n // 3)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rest = rest.repartition(tasks, "x")
    by = {c: [F.max(F.when(F.col("told") == t, F.col(c))).alias(f"{c}{int(t)}") for t in (False, True)] for c in CHAIN[1:]}
    rest = rest.groupBy("x").agg(*[x for pair in by.values() for x in pair]).select(
        "x", *[F.when(F.col(c[0] + "n1").isNotNull(), F.col(c + "1")).otherwise(F.col(c + "0")).alias(c) for c in CHAIN[1:]])
    rest_at = stored(rest)
    freed(spark, at)
    return opened(chains, rest_at), rest_at, taken


def _walk(batches):
    """Chains in one task: every node between the two ends of its chain."""
    import pyarrow as pa

    table = pa.Table.from_batches(list(batches))
    rows = list(zip(*(table[c].to_pylist() for c in CHAIN), strict=True))
    at = {row[0]: row for row in rows}
    plus = lambda a, b: None if a is None or b is None else a + b
    out, seen = [], set()
    for row in rows:
        for side in (0, 1):
            if row[2 + 3 * side] is not None or row[0] in seen:
                continue
            walk, cur, came, length = [], row, side, row[3 + 3 * side]  # from the end on this side to the other
            while True:
                walk.append((cur, came, length))
                _, ahead, back, step = cur[0], *cur[4 - 3 * came:7 - 3 * came]
                if back is None:
                    break
                cur, came, length = at[ahead], back, plus(length, step)
            start, rest = row[1 + 3 * side], step
            for cur, came, length in reversed(walk):
                out.append((cur[0], start, None, length, ahead, None, rest))
                seen.add(cur[0])
                rest = plus(rest, cur[3 + 3 * came])
    for i in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[i:i + 10_000], strict=True), table.schema, strict=True)], schema=table.schema)


def _expand(dist: DataFrame, like: DataFrame, gone: list[str]) -> DataFrame:
    """Distances ``(src, node, d)`` of the nodes that stay → of all: the last nodes taken out come back first, from both neighbours."""
    spark = dist.sparkSession
    kind = dist.select("node").union(like.select("x")).schema[0].dataType
    dist = dist.select("src", F.col("node").cast(kind).alias("node"), F.col("d").cast("double").alias("d"))
    known = [stored(dist)]
    for at in reversed(gone):
        sides = F.inline(F.array(*[F.struct(F.col(a + "n").cast(kind).alias("node"), F.col(a + "w").alias("w")) for a in "lr"]))
        near = opened(like, at).select(F.col("x").cast(kind).alias("x"), sides)
        back = near.join(shuffled(opened(dist, *known)), "node").groupBy("src", "x").agg(F.min(F.col("d") + F.col("w")).alias("d"))
        known.append(stored(back.select("src", F.col("x").alias("node"), "d")))
        freed(spark, at)
    return opened(dist, *known)


def shortest_paths(edges: DataFrame, sources: DataFrame, directed: bool = False) -> DataFrame:
    """single/multi-source shortest path lengths by iterative relaxation (Bellman-Ford).

    Undirected graphs are contracted first (:func:`contract_chains`, the sources stay): a road of many nodes without a
    junction is one arc, its inner nodes get their distance at the end from both neighbours.
    Each round joins only the vertices whose distance improved (the frontier)
    with their out-edges and keeps the minimum per (source, vertex).  The frontier
    is cut with a reliable checkpoint every round and the distance table every
    third round (its lineage never exceeds three joins); stops when nothing improves.
    Negative lengths are refused, so an empty frontier is always reached.
    """
    e = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("length_m").alias("w"))
    start = F.col(sources.columns[0])
    dist = cut_lineage(sources.select(start.alias("src"), start.alias("node"), F.lit(0.0).alias("d")).distinct())
    if not directed:  # both directions from one pass over the edges
        ends = e.select(*[F.col(c).cast(e.select("u").union(e.select("v")).schema[0].dataType).alias(c) for c in "uv"], "w")
        e = ends.select(F.inline(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))))
    # dealt out by the node that rounds join it on
    n_parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = e.repartition(n_parts, "u").groupBy("u", "v").agg(F.min("w").alias("w"))
    if directed:
        e = cut_lineage(e)  # the adjacency is joined in every round: materialised once
        if not e.where("w < 0").isEmpty():
            raise ValueError("shortest paths need edge lengths of 0 or more")
        return _relax(e.where("u <> v"), dist)
    whole_at, like, gone = contract_chains(e, sources)
    whole = opened(like.select(F.col("x").alias("u"), F.col("ln").alias("v"), F.col("lw").alias("w")), whole_at)
    dist = _relax(whole, dist)
    freed(edges.sparkSession, whole_at)
    return _expand(dist, like, gone) if gone else dist


def _relax(e: DataFrame, dist: DataFrame) -> DataFrame:
    """Distances over the arcs ``e(u, v, w)`` from those in ``dist(src, node, d)``."""
    frontier, rnd = dist, 0
    while True:
        cand = (frontier.join(e, frontier["node"] == e["u"]).select("src", F.col("v").alias("node"),
                                                                    (F.col("d") + F.col("w")).alias("d"))
                .groupBy("src", "node").agg(F.min("d").alias("d")))
        better = cand.join(dist.withColumnRenamed("d", "_old"), ["src", "node"], "left") \
                     .where(F.col("_old").isNull() | (F.col("d") < F.col("_old") - 1e-9)).select("src", "node", "d")
        better = kept(better)
        if better.isEmpty():
            return dist
        dist = dist.join(better.select("src", "node"), ["src", "node"], "left_anti").unionByName(better)
        rnd += 1
        if rnd % 3 == 0:  # the frontier is cut every round; the distance table every third (bounded lineage)
            dist = kept(dist)
        frontier = better
