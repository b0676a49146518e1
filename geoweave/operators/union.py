"""``ST_Union`` aggregate for polygons in any position: overlapping, nested, touching, with T-junctions.

The faces of one group (one feature's surfaces) are distinct parts.  A small feature is overlaid in one vectorised step, a large one
by joins on the cells of a grid over it (``large_union``), which leave to one task only the chaining of its boundary:

1. coordinates are snapped to a 1e-8 grid (as ``ST_Union(g, 1e-8)`` does) relative to the group's corner;
2. edges are split at crossings and at vertices that lie on them; equal pieces count once;
3. a piece bounds the union if exactly one of its sides is covered; a side is covered if some face holds a point
   beside the piece's middle by the even-odd rule, so the orientation of rings does not matter and
   a self-crossing ring covers its lobes;
4. boundary pieces, interior on their left, are chained clockwise at shared vertices, so faces that touch in a
   point stay separate rings; collinear vertices go, and each hole joins the shell around it.

A boundary that does not close, or a hole without a shell, raises; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import geom as G
from geoweave.session import cut_lineage

GRID = 1e8  # 1 / 1e-8
#: Grid steps within which a vertex lies on an edge, and from an edge's middle to the points beside it.
NEAR, BESIDE = 1.5, 8.0
#: Pairs (edge and edge, vertex and edge, point and edge) that are compared at a time; bounds memory, not what is compared.
PAIRS = 1 << 18
#: Vertices up to which a feature is overlaid in one step, and edges of a cell on average in the grid of a larger one.
SMALL, PER_CELL = 2000, 64
#: Grid steps around a cell within which edges count as its own.
MARGIN = 32


def _blocks(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows, each of about PAIRS cells of ``width`` a row."""
    step = max(1, PAIRS // max(1, width))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


def _covers(points: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """In how many polygons each point lies; the polygons' edges ``a -> b`` start at the indices ``first``."""
    rise = np.where(a[:, 1] == b[:, 1], 1.0, b[:, 1] - a[:, 1])
    out = np.zeros(len(points), np.int64)
    for s in _blocks(len(points), len(a)):
        x, y = points[s, :1], points[s, 1:]
        spans = (a[:, 1] > y) != (b[:, 1] > y)
        hit = spans & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / rise + a[:, 0])
        out[s] = (np.add.reduceat(hit.astype(np.int32), first, axis=1) % 2).sum(axis=1)
    return out


def _pieces(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct undirected pieces of the edges, split at crossings and at vertices on them."""
    d = b - a
    length = np.hypot(d[:, 0], d[:, 1])
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    cuts: list[list[tuple[float, float, float]]] = [[(0.0, *p), (1.0, *q)] for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    vertices = np.unique(a, axis=0)
    for rows in _blocks(len(a), len(vertices)):
        rel, size = vertices[None] - a[rows, None], length[rows, None]
        along = (rel * d[rows, None]).sum(-1) / size ** 2
        on = (np.abs(cross(rel, d[rows, None])) <= NEAR * size) & (along * size > NEAR) & ((1 - along) * size > NEAR)
        for i, k in zip(*np.nonzero(on), strict=True):
            cuts[rows.start + i].append((float(along[i, k]), *vertices[k].tolist()))
    inner = lambda s, k: (s * length[k] > NEAR) & ((1 - s) * length[k] > NEAR)
    for rows in _blocks(len(a), len(a)):
        i, j = np.nonzero(np.arange(rows.start, rows.stop)[:, None] < np.arange(len(a)))
        i += rows.start
        det = cross(d[i], d[j])
        gap = a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross(gap, d[j]) / det, cross(gap, d[i]) / det
        apart = np.abs(det) > NEAR * np.maximum(length[i], length[j])
        for x, y, s, w in ((i[k], j[k], t[k], u[k]) for k in np.flatnonzero(apart & inner(t, i) & inner(u, j))):
            p = np.round(a[x] + s * d[x]).tolist()
            cuts[x].append((float(s), *p))
            cuts[y].append((float(w), *p))
    found = set()
    for own in cuts:
        own.sort()
        for (_, *p), (_, *q) in zip(own, own[1:], strict=False):
            if p != q:
                found.add((*min(p, q), *max(p, q)))
    flat = np.array(sorted(found))
    return flat[:, :2], flat[:, 2:]


def _rings(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed pieces; at a shared vertex the next piece is the first one clockwise from the way back."""
    start, out = [tuple(x) for x in p.tolist()], {}
    end = [tuple(x) for x in q.tolist()]
    angle = np.arctan2(q[:, 1] - p[:, 1], q[:, 0] - p[:, 0])
    for k, v in enumerate(start):
        out.setdefault(v, []).append(k)
    left, rings = set(range(len(start))), []
    for first in range(len(start)):
        if first not in left:
            continue
        k, ring = first, []
        while True:
            left.discard(k)
            ring.append(start[k])
            back = angle[k] + np.pi
            ways = [n for n in out.get(end[k], ()) if n in left or n == first]
            if not ways:
                raise ValueError(f"the boundary does not close at {end[k]}")
            k = min(ways, key=lambda n: ((back - angle[n]) % (2 * np.pi)) or 2 * np.pi)
            if k == first:
                break
        rings.append(np.array(ring))
    return rings


def _plain(ring: np.ndarray) -> np.ndarray:
    """Ring without collinear vertices, closed, from its smallest vertex on."""
    while len(ring) > 3:
        before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
        turn = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
        flat = turn <= NEAR * np.maximum(np.hypot(*before.T), np.hypot(*after.T))
        flat &= ~np.roll(flat, 1) | (np.arange(len(flat)) % 2 == 0)  # of two flat neighbours one goes at a time
        if not flat.any():
            break
        ring = ring[~flat]
    k = min(range(len(ring)), key=lambda i: tuple(ring[i]))
    return np.concatenate([ring[k:], ring[: k + 1]])


def _canonical(ring: list[tuple[float, float]]) -> tuple[tuple[float, float], ...]:
    """Open ring of snapped vertices, counter-clockwise from the smallest one; repeated vertices count once."""
    r = [v for k, v in enumerate(ring) if v != ring[k - 1]]
    if len(r) < 3:
        return ()
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r[-1:] + r, r, strict=False)) < 0:
        r.reverse()
    k = r.index(min(r))
    return tuple(r[k:] + r[:k])


def _convex(ring: tuple[tuple[float, float], ...]) -> list[tuple[float, float]] | None:
    """The ring without collinear vertices if it is convex, else None."""
    steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    turns = [u[0] * v[1] - u[1] * v[0] for u, v in zip(steps[-1:] + steps, steps, strict=False)]
    for axis in (0, 1):
        signs = [d[axis] > 0 for d in steps if d[axis]]
        if sum(x != y for x, y in zip(signs[-1:] + signs, signs, strict=False)) > 2:
            return None
    return None if min(turns) < 0 or max(turns) <= 0 else [v for v, t in zip(ring, turns, strict=True) if t]


def overlay(parts: list[list[list[tuple[float, float]]]]) -> tuple[list[list[np.ndarray]], int]:
    """Union of polygons (each a list of rings of (x, y)) as parts of rings, shell first; and the number of edge
    pieces beside which two faces overlap."""
    snapped = lambda ring: [(float(round(x * GRID)), float(round(y * GRID))) for x, y in ring if x is not None and y is not None]
    faces = {tuple(r for r in (_canonical(snapped(ring)) for ring in part) if r) for part in parts} - {()}
    if len(faces) == 1:
        (face,) = faces
        plain = _convex(face[0]) if len(face) == 1 else None
        if plain:
            return [[np.array([*plain, plain[0]]) / GRID]], 0
    rings, first, n = [], [], 0
    for face in sorted(faces):
        first.append(n)
        n += sum(map(len, face))
        rings += [np.array(r) for r in face]
    if not rings:
        return [], 0
    corner = np.min([r.min(0) for r in rings], axis=0)
    rings = [r - corner for r in rings]
    a, b = np.concatenate(rings), np.concatenate([np.roll(r, -1, 0) for r in rings])
    p, q = _pieces(a, b)
    d = q - p
    side = np.c_[-d[:, 1], d[:, 0]] / np.hypot(d[:, 0], d[:, 1])[:, None] * BESIDE
    middle = (p + q) / 2
    starts = np.array(first)
    faces = _covers(np.concatenate([middle + side, middle - side]), a, b, starts)
    left, right = faces[: len(p)] > 0, faces[len(p):] > 0
    overlap = int((np.maximum(faces[: len(p)], faces[len(p):]) > 1).sum())
    rim = left != right
    p, q, turn = p[rim], q[rim], right[rim][:, None]
    return assemble(np.where(turn, q, p), np.where(turn, p, q), corner), overlap


def assemble(p: np.ndarray, q: np.ndarray, corner: np.ndarray) -> list[list[np.ndarray]]:
    """Parts of rings, shell first, of boundary pieces ``p -> q`` that have the interior on their left."""
    if not len(p):
        return []
    found = [_plain(r) for r in _rings(p, q)]
    area = [float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) for r in found]
    shells = sorted((k for k in range(len(found)) if area[k] > 0), key=lambda k: tuple(found[k][0]))
    out = {k: [found[k]] for k in shells}
    low, high = (np.array([f(found[k], axis=0) for k in shells]).reshape(-1, 2) for f in (np.min, np.max))
    for h in sorted((k for k in range(len(found)) if area[k] < 0), key=lambda k: tuple(found[k][0])):
        r = found[h]
        d = r[1] - r[0]
        beside = (r[0] + r[1]) / 2 + np.array([-d[1], d[0]]) / np.hypot(*d) * BESIDE
        near = np.flatnonzero(((low <= beside) & (beside <= high)).all(1))
        around = [k for k in (shells[x] for x in near) if _covers(beside[None], found[k][:-1], found[k][1:], np.array([0]))[0]]
        if not around:
            raise ValueError(f"the hole at {tuple(r[0] + corner)} has no shell")
        out[min(around, key=lambda k: area[k])].append(r)
    return [[(r + corner) / GRID for r in part] for part in out.values()]


SHAPE = "array<array<array<array<double>>>>"
_NESTED = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


def _flat(part):
    return F.transform(part, lambda ring: F.transform(ring, lambda v: F.array(v["x"], v["y"])))


def _geometry(done: DataFrame, key: str, geom_col: str, srid: int | None) -> DataFrame:
    rings = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda v: G.vertex(v[0], v[1]))))
    return done.select(F.col("_k").alias(key), G.make_geom("MULTIPOLYGON", rings, srid).alias(geom_col), "overlap_edges")


def union_agg(df: DataFrame, key: str, geom_col: str = "geom", srid: int | None = None, small: int = SMALL) -> DataFrame:
    """Union of the polygons of each ``key`` group → ``(key, geom MULTIPOLYGON, overlap_edges)``.

    ``key`` is a feature and its rows its faces; repeated faces combine.  Groups whose faces enclose no area have no row.
    ``overlap_edges`` counts edge pieces beside which two different faces overlap (0 for a clean coverage).
    Features of up to ``small`` vertices are overlaid in one step, the faces of larger ones by ``large_union``.
    """
    size = F.aggregate(F.col(geom_col)["parts"], F.lit(0), lambda n, part: n + F.aggregate(part, F.lit(0), lambda m, ring: m + F.size(ring)))
    large = cut_lineage(df.select(F.col(key).alias("_k"), size.alias("n")).groupBy("_k").agg(F.sum("n").alias("n"))
                        .where(F.col("n") > small).select("_k"))
    faces = df.select(F.col(key).alias("_k"), F.explode(F.col(geom_col)["parts"]).alias("part")).select("_k", _flat("part").alias("part"))
    if large.isEmpty():
        return _geometry(_overlaid(faces), key, geom_col, srid)
    done = _overlaid(faces.join(large, "_k", "left_anti")).unionByName(large_union(faces.join(large, "_k", "left_semi")))
    return _geometry(done, key, geom_col, srid)


def make_valid(df: DataFrame, key: str, geom_col: str = "geom", srid: int | None = None, small: int = SMALL) -> DataFrame:
    """``df`` with valid areas: rings are noded at their crossings and the faces that an odd number of rings of a part holds are kept.

    ``key`` identifies a row.  A bow tie becomes its two lobes, a hole that reaches over its shell adds what lies outside, parts
    that overlap are joined; what encloses no area becomes an empty multipolygon.  Other geometry types and nulls stay.
    """
    areal = F.col(geom_col)["type"].isin("POLYGON", "MULTIPOLYGON")
    valid = union_agg(df.where(areal).select(key, geom_col), key, geom_col, srid, small).select(
        F.col(key).alias("_id"), F.col(geom_col)["parts"].alias("_parts"))
    empty = F.filter(F.col(geom_col)["parts"], lambda p: F.lit(False))
    rows = df.join(valid, df[key].eqNullSafe(F.col("_id")), "left")
    fixed = F.col(geom_col).withField("parts", F.coalesce("_parts", empty)).withField("type", F.lit("MULTIPOLYGON"))
    return rows.withColumn(geom_col, F.when(areal, fixed).otherwise(F.col(geom_col))).select(*df.columns)


def _overlaid(faces: DataFrame) -> DataFrame:
    """Overlay of all faces of a feature in one step."""
    grouped = faces.groupBy("_k").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    kind = faces.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [overlay(parts) for parts in batch.column(1).to_pylist()]
            keep = [k for k, (parts, _) in enumerate(rows) if parts]
            nested = pa.array([[[r.tolist() for r in part] for part in rows[k][0]] for k in keep], _NESTED)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), nested,
                                              pa.array([rows[k][1] for k in keep], pa.int64())], ["_k", "parts", "overlap_edges"])

    return grouped.mapInArrow(run, f"_k {kind}, parts {SHAPE}, overlap_edges long")


def _cells(x0, y0, x1, y1) -> tuple[Column, Column]:
    """Columns of cells that an edge from (x0, y0) to (x1, y1), x0 <= x1, touches or passes within MARGIN; and the rows in column ``i``.

    Coordinates are grid steps from the feature's corner; ``w`` and ``h`` are a cell's sides.
    """
    columns = F.sequence(F.floor((x0 - MARGIN) / F.col("w")), F.floor((x1 + MARGIN) / F.col("w")))
    left, right = F.col("i") * F.col("w") - MARGIN, (F.col("i") + 1) * F.col("w") + MARGIN
    steep = F.when(x1 > x0, (y1 - y0) / (x1 - x0))
    at = lambda x: F.coalesce(y0 + (F.greatest(x0, F.least(x1, x)) - x0) * steep, y0)
    low = F.when(x1 > x0, F.least(at(left), at(right))).otherwise(F.least(y0, y1))
    high = F.when(x1 > x0, F.greatest(at(left), at(right))).otherwise(F.greatest(y0, y1))
    return columns, F.sequence(F.floor((low - MARGIN) / F.col("h")), F.floor((high + MARGIN) / F.col("h")))


def _cut_points(edges: np.ndarray) -> np.ndarray:
    """Rows (edge, place along it, x, y) at which edges ``(ax, ay, bx, by)`` cross or hold another one's vertex."""
    a, b = edges[:, :2], edges[:, 2:]
    d = b - a
    length = np.hypot(d[:, 0], d[:, 1])
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    out = [np.zeros((0, 4))]
    vertices = np.unique(np.concatenate([a, b]), axis=0)
    for rows in _blocks(len(a), len(vertices)):
        rel, size = vertices[None] - a[rows, None], length[rows, None]
        along = (rel * d[rows, None]).sum(-1) / size ** 2
        on = (np.abs(cross(rel, d[rows, None])) <= NEAR * size) & (along * size > NEAR) & ((1 - along) * size > NEAR)
        i, k = np.nonzero(on)
        out.append(np.c_[i + rows.start, along[i, k], vertices[k]])
    inner = lambda s, k: (s * length[k] > NEAR) & ((1 - s) * length[k] > NEAR)
    for rows in _blocks(len(a), len(a)):
        i, j = np.nonzero(np.arange(rows.start, rows.stop)[:, None] < np.arange(len(a)))
        i += rows.start
        det, gap = cross(d[i], d[j]), a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross(gap, d[j]) / det, cross(gap, d[i]) / det
        found = (np.abs(det) > NEAR * np.maximum(length[i], length[j])) & inner(t, i) & inner(u, j)
        i, j, t, u = i[found], j[found], t[found], u[found]
        point = np.round(a[i] + t[:, None] * d[i])
        out += [np.c_[i, t, point], np.c_[j, u, point]]
    return np.concatenate(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one cell a row to the edges' cut points."""
    for batch in batches:
        for k, flat in zip(batch.column(0), batch.column(1), strict=True):
            edges = np.unique(np.array(flat.values.flatten()).reshape(-1, 4), axis=0)  # the same order in every cell
            cuts = _cut_points(edges)
            e = edges[cuts[:, 0].astype(int)]
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(cuts), batch.schema.field(0).type),
                                              *(pa.array(x) for x in (*e.T, *cuts[:, 1:].T))], ["_k", "ax", "ay", "bx", "by", "t", "x", "y"])


def _cover_counts(ref: np.ndarray, others: int, inside: dict[int, int], face: np.ndarray, edges: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Faces over each point: from the reference point along x, then along y, every edge of a face that is crossed changes its side."""
    order = np.argsort(face, kind="stable")
    face, edges = face[order], edges[order]
    first = np.flatnonzero(np.r_[True, face[1:] != face[:-1]])
    start = np.array([inside.get(int(f), 0) for f in face[first]])
    ax, ay, bx, by = edges.T
    level = (ay > ref[1]) != (by > ref[1])
    at = ax + (ref[1] - ay) / np.where(ay == by, 1.0, by - ay) * (bx - ax)
    out = np.zeros(len(points), np.int64)
    for s in _blocks(len(points), len(edges)):
        x, y = points[s, :1], points[s, 1:]
        along = level & ((at > ref[0]) != (at > x))
        up = (ax > x) != (bx > x)
        height = ay + (x - ax) / np.where(ax == bx, 1.0, bx - ax) * (by - ay)
        crossed = along.astype(np.int32) + (up & ((height > ref[1]) != (height > y)))
        out[s] = ((np.add.reduceat(crossed, first, axis=1) + start) % 2).sum(1)
    return out + others


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one cell a row, with its faces, to boundary pieces (interior on the left) and pieces beside which faces overlap."""
    names = ["_k", "px", "py", "qx", "qy", "overlap"]
    for batch in batches:
        for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):  # one cell as Python objects at a time
            p = np.array([(r["px"], r["py"], r["qx"], r["qy"]) for r in row["pieces"]])
            edges = np.array([(r["ax"], r["ay"], r["bx"], r["by"]) for r in row["edges"]]).reshape(-1, 4)
            face = np.array([r["face"] for r in row["edges"]], np.int64)
            inside = {r["face"]: r["inside"] for r in row["faces"]}
            others = row["covering"] - sum(inside.values())
            ref = np.array([row["rx"], row["ry"]])
            d, middle = p[:, 2:] - p[:, :2], (p[:, 2:] + p[:, :2]) / 2
            side = np.c_[-d[:, 1], d[:, 0]] / np.hypot(d[:, 0], d[:, 1])[:, None] * BESIDE
            n = _cover_counts(ref, others, inside, face, edges, np.concatenate([middle + side, middle - side]))
            left, right = n[:len(p)], n[len(p):]
            rim, overlap = (left > 0) != (right > 0), np.maximum(left, right) > 1
            turned = np.where((right > 0)[:, None] & rim[:, None], p[:, [2, 3, 0, 1]], p)
            keep = rim | overlap
            turned[~rim] = np.nan  # no boundary, counted only
            yield pa.RecordBatch.from_arrays([pa.array([row["_k"]] * int(keep.sum()), batch.schema.field("_k").type),
                                              *(pa.array(x) for x in turned[keep].T), pa.array(overlap[keep].astype(np.int64))], names)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A feature's boundary pieces to its parts."""
    for batch in batches:
        for k, x0, y0, pieces, overlap in zip(*batch.columns, strict=True):
            p = np.array(pieces.values.flatten()).reshape(-1, 4)
            p = p[np.lexsort(p.T[::-1])]
            parts = assemble(p[:, :2], p[:, 2:], np.array([x0.as_py(), y0.as_py()]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], batch.schema.field(0).type), pa.array(
                    [[[r.tolist() for r in part] for part in parts]], _NESTED), pa.array([overlap.as_py()], pa.int64())], ["_k", "parts", "overlap_edges"])


def large_union(faces: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """``_k, parts, overlap_edges`` of faces ``_k, part``, by joins on the cells of a grid over each feature.

    Edges are exploded to the cells that they pass; a cell finds the cuts of its edges, an edge gathers its own cuts and becomes pieces.
    How many faces cover a cell's reference point follows from crossings along its row (running sums of entries and exits); a piece's
    sides are counted from there with the cell's own edges.  Only boundary pieces meet again, to be chained.
    """
    kind = faces.schema["_k"].dataType.simpleString()

    def canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = [[r for r in (_canonical([(float(round(x * GRID)), float(round(y * GRID))) for x, y in ring if x is not None and y is not None])
                                  for ring in part) if r] for part in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rings, pa.list_(pa.list_(pa.list_(pa.float64()))))], ["_k", "rings"])

    rings = (faces.mapInArrow(canonical, f"_k {kind}, rings array<array<array<double>>>").where(F.size("rings") > 0)
             .groupBy("_k", F.xxhash64("rings").alias("face")).agg(F.first("rings").alias("rings"))
             .select("_k", "face", F.explode("rings").alias("ring")))
    edges = rings.select("_k", "face", F.posexplode("ring").alias("pos", "a"), "ring").select(
        "_k", "face", "a", F.col("ring")[(F.col("pos") + 1) % F.size("ring")].alias("b"))
    edges = edges.select("_k", "face", *(F.col(v)[k].alias(v + c) for v in "ab" for k, c in enumerate("xy")))
    turned = F.struct("ax", "ay") > F.struct("bx", "by")  # from the smaller end on
    edges = cut_lineage(edges.select("_k", "face", *(F.when(turned, F.col(o)).otherwise(F.col(c)).alias(c)
                                                     for c, o in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay")))))
    # cells are squares: in a long feature, cells of its shape would each hold a slice of many edges
    extent = edges.groupBy("_k").agg(F.min("ax").alias("x0"), F.min(F.least("ay", "by")).alias("y0"), F.max("bx").alias("x1"),
                                     F.max(F.greatest("ay", "by")).alias("y1"), (F.lit(per_cell) / F.count("*")).alias("share"))
    extent = extent.select("_k", "x0", "y0", (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height"), "share")
    side = F.greatest(F.sqrt(F.col("width") * F.col("height") * F.col("share")), F.greatest("width", "height") * F.col("share"))
    frames = cut_lineage(extent.select("_k", "x0", "y0", F.ceil(F.least("width", side)).cast("double").alias("w"),
                                       F.ceil(F.least("height", side)).cast("double").alias("h")))
    shifted = edges.join(frames, "_k")
    shifted = shifted.select("_k", "face", "w", "h", *((F.col(c) - F.col(c[1] + "0")).alias(c) for c in ("ax", "ay", "bx", "by")))
    columns, rows = _cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    placed = shifted.withColumn("i", F.explode(columns)).withColumn("j", F.explode(rows))
    ends = ["ax", "ay", "bx", "by"]
    cuts = (placed.groupBy("_k", "i", "j").agg(F.collect_set(F.array(*ends)).alias("edges")).select("_k", "edges")
            .mapInArrow(_cut, f"_k {kind}, ax double, ay double, bx double, by double, t double, x double, y double"))
    points = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y"))),
                      F.array_sort(F.array_distinct("cuts")), F.array(F.struct(F.lit(1.0).alias("t"), F.col("bx").alias("x"), F.col("by").alias("y"))))
    split = (shifted.select("_k", "w", "h", *ends).distinct()
             .join(cuts.groupBy("_k", *ends).agg(F.collect_set(F.struct("t", "x", "y")).alias("cuts")), ["_k", *ends], "left")
             .withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<t:double,x:double,y:double>>")))
             .withColumn("points", points))
    pairs = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda k: F.struct(
        *(F.col("points")[k + o][c].alias(n + c) for o, n in ((-1, "p"), (0, "q")) for c in "xy")))
    piece = F.col("piece")
    back = F.struct(piece["px"], piece["py"]) > F.struct(piece["qx"], piece["qy"])
    pieces = (split.select("_k", "w", "h", F.explode(pairs).alias("piece"))
              .where((piece["px"] != piece["qx"]) | (piece["py"] != piece["qy"]))
              .select("_k", "w", "h", *(F.when(back, piece[o]).otherwise(piece[c]).alias(c)
                                        for c, o in (("px", "qx"), ("py", "qy"), ("qx", "px"), ("qy", "py")))).distinct()
              .withColumns({"i": F.floor((F.col("px") + F.col("qx")) / 2 / F.col("w")), "j": F.floor((F.col("py") + F.col("qy")) / 2 / F.col("h"))}))
    own = pieces.groupBy("_k", "w", "h", "i", "j").agg(F.collect_list(F.struct("px", "py", "qx", "qy")).alias("pieces"))
    rx, ry = (F.col("i") + 0.5) * F.col("w") + 0.25, (F.col("j") + 0.5) * F.col("h") + 0.25
    own = cut_lineage(own.withColumns({"rx": rx, "ry": ry}))
    local = placed.select("_k", "i", "j", "face", *ends)
    # entries and exits of each face along the reference line of each row
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    line = (F.col("j") + 0.5) * F.col("h") + 0.25
    events = (shifted.withColumn("j", F.explode(F.sequence(F.floor(low / F.col("h")) - 1, F.floor(high / F.col("h")) + 1)))
              .where((low < line) & (line < high))
              .select("_k", "face", "j", (F.col("ax") + (line - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))).alias("x")))
    turn = F.row_number().over(Window.partitionBy("_k", "face", "j").orderBy("x")) % 2 * 2 - 1
    events = cut_lineage(events.withColumn("v", turn).withColumn("i", F.lit(None).cast("long")))
    upto = lambda *by: F.coalesce(F.sum("v").over(Window.partitionBy(*by).orderBy("x", F.col("i").isNotNull())
                                                  .rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    asked = local.join(own.select("_k", "i", "j", "rx"), ["_k", "i", "j"])
    each = (events.select("_k", "face", "j", "x", "v", "i").unionByName(
        asked.select("_k", "face", "j", F.col("rx").alias("x"), F.lit(0).alias("v"), "i").distinct())
        .withColumn("inside", upto("_k", "face", "j")).where("i is not null").select("_k", "i", "j", "face", F.col("inside").cast("int").alias("inside")))
    total = (events.select("_k", "j", "x", "v", "i").unionByName(own.select("_k", "j", F.col("rx").alias("x"), F.lit(0).alias("v"), "i"))
             .withColumn("covering", upto("_k", "j")).where("i is not null").select("_k", "i", "j", F.col("covering").cast("int").alias("covering")))
    cell = (own.join(asked.groupBy("_k", "i", "j").agg(F.collect_list(F.struct("face", *ends)).alias("edges")), ["_k", "i", "j"])
            .join(each.groupBy("_k", "i", "j").agg(F.collect_list(F.struct("face", "inside")).alias("faces")), ["_k", "i", "j"])
            .join(total, ["_k", "i", "j"]))
    sides = cell.select("_k", "pieces", "edges", "faces", "covering", "rx", "ry").mapInArrow(
        _sides, f"_k {kind}, px double, py double, qx double, qy double, overlap long")
    rim = F.when(~F.isnan("px"), F.array("px", "py", "qx", "qy"))
    grouped = sides.groupBy("_k").agg(F.collect_list(rim).alias("rim"), F.sum("overlap").alias("overlap_edges")).join(frames, "_k")
    return grouped.select("_k", "x0", "y0", "rim", "overlap_edges").mapInArrow(_chain, f"_k {kind}, parts {SHAPE}, overlap_edges long")
