"""3D city pipeline (C1, C3-C10, C12, C13) over 3DCityDB-shaped DataFrames.

Tables (columns actually used): ``building(id, lod0_footprint_id, lod1..4_multi_surface_id,
lod1..4_solid_id, measured_height)``, ``cityobject(id, gmlid, envelope, objectclass_id, lineage)``,
``thematic_surface(id, building_id, lod2..4_multi_surface_id, objectclass_id)``,
``surface_geometry(id, gmlid, parent_id, root_id, geometry, cityobject_id)``,
``cityobject_genericattrib(cityobject_id, attrname, strval, urival)``.

Object classes: 32 floor, 33 roof, 34 wall, 35 ground.  Operators marked
*[gap]* implement our own definition where the reference's SQL is not public.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import geom as G
from geoweave.functions.pgcompat import stable_uuid
from geoweave.operators.relational import with_ordinal
from geoweave.operators.union import union_agg
from geoweave.session import cut_lineage, shuffled

GROUND, ROOF, WALL, FLOOR = 35, 33, 34, 32
BUILDING_LOD_KEYS = ["lod4_multi_surface_id", "lod3_multi_surface_id", "lod2_multi_surface_id",
                     "lod1_multi_surface_id", "lod4_solid_id", "lod3_solid_id", "lod2_solid_id", "lod1_solid_id"]
SURFACE_LOD_KEYS = ["lod4_multi_surface_id", "lod3_multi_surface_id", "lod2_multi_surface_id"]


def prefer_lod(df: DataFrame, keys) -> Column:
    """Ordered preference over LoD id columns (missing columns are skipped)."""
    return F.coalesce(*[F.col(k) for k in keys if k in df.columns])


def to_raw_buildings(df: DataFrame, column_map: Mapping[str, str], min_area: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Footprint × height (+ elevation) → ``(id, gmlid, geom solid, mh)`` and the columns named in ``keep``.

    ``column_map`` names ``id``, ``footprint`` (``polygon`` accepted too, trap T10),
    ``height`` and optionally ``elevation`` and ``gmlid``.  NULL heights are dropped;
    footprints with area ≤ ``min_area`` are dropped *[gap: our default]*.
    """
    fp = column_map.get("footprint", column_map.get("polygon"))
    idc, hc = column_map["id"], column_map["height"]
    elev = F.col(column_map["elevation"]) if "elevation" in column_map else F.lit(0.0)
    gml = F.col(column_map["gmlid"]) if "gmlid" in column_map else stable_uuid(idc, prefix="building_")
    base = df.where(F.col(hc).isNotNull()).where(G.st_area(F.col(fp)) > min_area)
    solid = G.st_translate(G.st_extrude(G.st_force3d(G.st_force2d(F.col(fp)), 0.0), F.col(hc).cast("double")),
                           0.0, 0.0, elev.cast("double"))
    return base.select(F.col(idc).alias("id"), gml.alias("gmlid"), solid.alias("geom"), F.col(hc).cast("double").alias("mh"), *keep)


def to_raw_surfaces(buildings: DataFrame) -> DataFrame:
    """Dump solid faces; flat at the building's lowest z → ground (35), other flat → roof (33),
    else wall (34); rings reversed as the reference does.  Output ``(building_gmlid, gmlid, class, geom)``."""
    faces = buildings.select(F.col("gmlid").alias("building_gmlid"), G.st_zmin("geom").alias("bzl"),
                             F.posexplode(G.st_dump("geom")).alias("face_no", "face"))
    zmin, zmax = G.st_zmin("face"), G.st_zmax("face")
    cls = F.when(zmin == zmax, F.when(zmin == F.col("bzl"), F.lit(GROUND)).otherwise(F.lit(ROOF))).otherwise(F.lit(WALL))
    return faces.select("building_gmlid", stable_uuid("building_gmlid", "face_no", prefix="surface_").alias("gmlid"),
                        cls.alias("class"), G.st_reverse("face").alias("geom"))


def populate_city_tables(raw_b: DataFrame, raw_s: DataFrame, lineage: str, id_base: int = 0,
                         attributes: Sequence[str] = ()) -> dict[str, DataFrame]:
    """C4 *[gap]*: raw buildings/surfaces → cityobject, building, thematic_surface, surface_geometry, cityobject_genericattrib.

    Ids are dense ordinals (no single-partition window): buildings first, then
    surfaces, then one geometry row per surface.  Every column of ``raw_b`` named in ``attributes`` gives one attribute row per
    building where it is not NULL, as text in ``strval``, or in ``urival`` if it holds an IRI.
    """
    b = with_ordinal(raw_b, ["gmlid"], "ord").withColumn("bid", F.col("ord") + id_base)
    nb = b.agg(F.max("ord")).first()[0] or 0
    s = with_ordinal(raw_s, ["gmlid"], "ord").withColumn("sid", F.col("ord") + id_base + nb)
    ns = s.agg(F.max("ord")).first()[0] or 0
    s = s.join(shuffled(b.select(F.col("gmlid").alias("building_gmlid"), "bid")), "building_gmlid")
    s = s.withColumn("gid", F.col("sid") + ns)
    cityobject = b.select(F.col("bid").alias("id"), "gmlid", G.st_envelope("geom").alias("envelope"),
                          F.lit(26).alias("objectclass_id"), F.lit(lineage).alias("lineage")).unionByName(
        s.select(F.col("sid").alias("id"), "gmlid", G.st_envelope("geom").alias("envelope"),
                 F.col("class").alias("objectclass_id"), F.lit(lineage).alias("lineage")))
    building = b.select(F.col("bid").alias("id"), F.lit(None).cast("bigint").alias("lod0_footprint_id"),
                        F.lit(None).cast("bigint").alias("lod2_multi_surface_id"),
                        F.lit(None).cast("bigint").alias("lod2_solid_id"), F.col("mh").alias("measured_height"))
    thematic = s.select(F.col("sid").alias("id"), F.col("bid").alias("building_id"),
                        F.col("gid").alias("lod2_multi_surface_id"), F.col("class").alias("objectclass_id"))
    geometry = s.select(F.col("gid").alias("id"), F.concat("gmlid", F.lit("_geom")).alias("gmlid"),
                        F.lit(None).cast("bigint").alias("parent_id"), F.col("gid").alias("root_id"),
                        F.col("geom").alias("geometry"), F.col("sid").alias("cityobject_id"))
    none = F.lit(None).cast("string")
    named = F.array(*[F.struct(F.lit(a).alias("attrname"), F.col(a).cast("string").alias("v")) for a in attributes]) if attributes \
        else F.lit(None).cast("array<struct<attrname:string,v:string>>")
    uri = F.col("a.v").rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    attrs = b.select("bid", F.explode(named).alias("a")).where(F.col("a.v").isNotNull()).select(
        F.col("bid").alias("cityobject_id"), "a.attrname", F.when(uri, none).otherwise(F.col("a.v")).alias("strval"),
        F.when(uri, F.col("a.v")).alias("urival"))
    return {"cityobject": cityobject, "building": building, "thematic_surface": thematic, "surface_geometry": geometry,
            "cityobject_genericattrib": attrs}


def newell_normal(ring: Column) -> Column:
    """Face normal by Newell's method (struct nx, ny, nz)."""
    idx = F.sequence(F.lit(0), F.size(ring) - 2)
    def comp(a, b):
        return F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + (ring[i][a] - ring[i + 1][a]) * (ring[i][b] + ring[i + 1][b]))
    return F.struct(comp("y", "z").alias("nx"), comp("z", "x").alias("ny"), comp("x", "y").alias("nz"))


def discover_surfaces(faces: DataFrame, building_col: str = "building_gmlid", geom_col: str = "geom",
                      crit_ratio: float = 0.1) -> DataFrame:
    """C5 *[gap]*: classify untagged faces.  |n_z| / |n| < ratio → wall; otherwise the face(s)
    lying at the building's lowest z → ground; other horizontal-ish faces → roof."""
    ring = F.col(geom_col)["parts"][0][0]
    n = newell_normal(ring)
    norm = F.sqrt(n["nx"] * n["nx"] + n["ny"] * n["ny"] + n["nz"] * n["nz"])
    f = faces.withColumn("_ratio", F.abs(n["nz"]) / F.when(norm > 0, norm)).withColumn("_zmax", G.st_zmax(geom_col))
    f = f.where(F.col(building_col).isNotNull()).withColumn("_zmin", G.st_zmin(geom_col))
    f = f.withColumn("_bzmin", F.min("_zmin").over(Window.partitionBy(building_col)))
    cls = (F.when(F.col("_ratio").isNull() | (F.col("_ratio") < crit_ratio), F.lit(WALL))
           .when(F.col("_zmax") == F.col("_bzmin"), F.lit(GROUND)).otherwise(F.lit(ROOF)))
    return f.withColumn("class", cls).select(building_col, *[c for c in faces.columns if c not in (building_col, "class")], "class")


def add_building_height(building: DataFrame, faces: DataFrame, id_col: str = "id", face_building: str = "building_id",
                        geom_col: str = "geometry") -> DataFrame:
    """C6 *[gap]*: measured_height, where NULL, from the building's faces (zmax − zmin)."""
    h = faces.groupBy(face_building).agg((F.max(G.st_zmax(geom_col)) - F.min(G.st_zmin(geom_col))).alias("_h"))
    out = building.join(shuffled(h), building[id_col] == h[face_building], "left")
    return out.withColumn("measured_height", F.coalesce("measured_height", "_h")).drop("_h", face_building)


def add_footprint(building: DataFrame, cityobject: DataFrame, thematic: DataFrame, surfaces: DataFrame,
                  srid: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Footprints for buildings lacking one.

    precise = union of 2D ground faces (35); rough = union of every face with
    area > 0 for buildings with no precise footprint; parts are lifted to the
    building's zmin; a parent geometry row ``gmlid_footprint`` and one child row
    ``gmlid_footprint_child`` per POLYGON part are added; ``lod0_footprint_id`` is
    set only where NULL.  Returns ``(building, surface_geometry, footprints)`` where
    ``footprints(id, kind, geom)`` is the union per building.
    """
    bwf = (building.where(F.col("lod0_footprint_id").isNull()).select("id")
           .join(shuffled(cityobject.select("id", "gmlid", G.st_zmin("envelope").alias("zmin"))), "id"))
    ts = thematic.select(F.col("building_id"), F.col("objectclass_id"),
                         prefer_lod(thematic, SURFACE_LOD_KEYS).alias("_troot"))
    sg = surfaces.where(F.col("geometry").isNotNull()).select("root_id", "geometry")
    ground = (sg.join(shuffled(ts.where(F.col("objectclass_id") == GROUND)), sg["root_id"] == ts["_troot"])
              .join(shuffled(bwf.select(F.col("id").alias("building_id"))), "building_id", "left_semi"))
    # "a precise footprint exists" = the building has ground faces (the reference groups them even when
    # their union is empty), so rough sources are known before any union is computed
    has_ground = ground.select(F.col("building_id").alias("bkey")).distinct()
    bl = building.select(F.col("id").alias("_bid"), prefer_lod(building, BUILDING_LOD_KEYS).alias("_broot"))
    rough_src = (sg.where(G.st_area("geometry") > 0.0)
                 .join(shuffled(bl), sg["root_id"] == bl["_broot"], "left")
                 .join(shuffled(ts.select("building_id", "_troot")), sg["root_id"] == ts["_troot"], "left")
                 .withColumn("bkey", F.coalesce("_bid", "building_id")))
    # NOT EXISTS precise (NULL keys would be kept) … AND key IN (buildings without footprint) (drops them): T6
    rough_src = (rough_src.join(shuffled(has_ground), "bkey", "left_anti")
                 .join(shuffled(bwf.select(F.col("id").alias("bkey"))), "bkey", "left_semi"))
    # a building is either precise or rough, never both: one union pass over both face sets;
    # the union is read several times below, so it is materialised once (reliable checkpoint)
    faces = (ground.select(F.col("building_id").alias("bkey"), G.st_force2d("geometry").alias("g"))
             .unionByName(rough_src.select("bkey", G.st_force2d("geometry").alias("g"))))
    unioned = union_agg(faces, "bkey", "g", srid)
    kind = F.when(F.col("_hg").isNotNull(), F.lit("precise")).otherwise(F.lit("rough"))
    fps = cut_lineage(unioned.join(shuffled(has_ground.withColumn("_hg", F.lit(True))), "bkey", "left")
                      .select(F.col("bkey").alias("id"), kind.alias("kind"), F.col("g").alias("geom")))
    soup = (bwf.join(shuffled(fps), "id", "left")
            .select("id", "gmlid", "zmin", F.posexplode_outer(G.st_dump("geom")).alias("part_no", "part"))
            .select("id", "gmlid", "part_no", G.st_force3d("part", F.col("zmin")).alias("geometry")))
    # new surface_geometry ids continue the existing sequence: parents first (by building id), then the
    # children (by building id, part number) — one distributed ordinal pass, evaluated lazily
    max_id = surfaces.agg(F.max("id")).first()[0] or 0
    par_src = bwf.select("id", "gmlid", F.lit(0).alias("_tag"), F.lit(-1).alias("part_no"),
                         F.lit(None).cast(G.GEOM).alias("geometry"))
    kid_src = soup.where(F.col("geometry")["type"] == "POLYGON").select(
        "id", "gmlid", F.lit(1).alias("_tag"), "part_no", "geometry")
    numbered = with_ordinal(par_src.unionByName(kid_src), ["_tag", "id", "part_no"], "ord").withColumn(
        "new_id", F.col("ord") + max_id)
    parents = numbered.where("_tag = 0").select(F.col("new_id").alias("footprint_id"), F.col("id").alias("bid"), "gmlid")
    parent_rows = parents.select(F.col("footprint_id").alias("id"), F.concat("gmlid", F.lit("_footprint")).alias("gmlid"),
                                 F.lit(None).cast("bigint").alias("parent_id"), F.col("footprint_id").alias("root_id"),
                                 F.lit(None).cast(G.GEOM).alias("geometry"), F.col("bid").alias("cityobject_id"))
    kids = numbered.where("_tag = 1").join(shuffled(parents.select("bid", "footprint_id")), F.col("id") == F.col("bid"))
    child_rows = kids.select(F.col("new_id").alias("id"),
                             F.concat("gmlid", F.lit("_footprint_child")).alias("gmlid"),
                             F.col("footprint_id").alias("parent_id"), F.col("footprint_id").alias("root_id"),
                             "geometry", F.col("id").alias("cityobject_id"))
    cols = ["id", "gmlid", "parent_id", "root_id", "geometry", "cityobject_id"]
    sg_all = surfaces.select(*[F.col(c) if c in surfaces.columns else F.lit(None).alias(c) for c in cols])
    new_sg = sg_all.unionByName(parent_rows).unionByName(child_rows).withColumn(
        "root_id", F.coalesce("root_id", "id"))
    b2 = building.join(shuffled(parents.select(F.col("bid").alias("id"), "footprint_id")), "id", "left").withColumn(
        "lod0_footprint_id", F.coalesce("lod0_footprint_id", "footprint_id")).drop("footprint_id")
    return b2, new_sg, fps


def footprint_layer(building: DataFrame, surfaces: DataFrame, attrs: DataFrame, flip: bool = False,
                    default_height: float = 100.0) -> DataFrame:
    """Map-ready footprints: ``building_id, building_height (default 100), geometry, uuid, iri``.

    Inner joins throughout (J2 + J7): a building without a uuid or iri attribute is absent.
    """
    uuid = attrs.where(F.col("attrname") == "uuid").select(F.col("strval").alias("uuid"), F.col("cityobject_id").alias("_u"))
    iri = attrs.where(F.col("attrname") == "iri").select(F.col("urival").alias("iri"), F.col("cityobject_id").alias("_i"))
    g = surfaces.where(F.col("geometry").isNotNull()).select("root_id", "geometry")
    j = (building.join(shuffled(g), building["lod0_footprint_id"] == g["root_id"])
         .join(shuffled(uuid), building["id"] == uuid["_u"]).join(shuffled(iri), building["id"] == iri["_i"]))
    geom = G.st_flip_coordinates("geometry") if flip else F.col("geometry")
    return j.select(F.col("id").alias("building_id"),
                    F.coalesce(F.col("measured_height").cast("double"), F.lit(default_height)).alias("building_height"),
                    geom.alias("geometry"), "uuid", "iri")


def add_iris(objects: DataFrame, base_iri: str, previous: DataFrame | None = None, id_col: str = "gmlid",
             class_name: str = "Building") -> DataFrame:
    """C9 *[gap]*: uuid + IRI per object; values from a previous import (same gmlid) win."""
    new = objects.select(id_col, stable_uuid(id_col).alias("_nu"))
    new = new.withColumn("_ni", F.concat(F.lit(f"{base_iri}{class_name}/"), F.col("_nu")))
    if previous is not None:
        prev = previous.select(id_col, F.col("uuid").alias("_pu"), F.col("iri").alias("_pi"))
        new = new.join(prev, id_col, "left")
    else:
        new = new.withColumn("_pu", F.lit(None).cast("string")).withColumn("_pi", F.lit(None).cast("string"))
    return new.select(id_col, F.coalesce("_pu", "_nu").alias("uuid"), F.coalesce("_pi", "_ni").alias("iri"))


def import_objects(existing: DataFrame, incoming: DataFrame, lineage: str, append: bool = False,
                   key: str = "gmlid") -> DataFrame:
    """Non-append deletes the lineage first; incoming rows with a known ``key`` are skipped, and of several incoming rows
    with one new ``key`` one stays (rows without a key all stay)."""
    kept = existing if append else existing.where(~F.col("lineage").eqNullSafe(F.lit(lineage)))
    fresh = incoming.withColumn("lineage", F.lit(lineage)).join(kept.select(key), key, "left_anti")
    fresh = fresh.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(fresh.where(F.col(key).isNull()))
    return kept.unionByName(fresh, allowMissingColumns=True)


def quadkey_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile indices (x, y) at ``zoom``."""
    n = float(2 ** zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    rad = F.radians(lat)
    y = F.floor((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / 3.141592653589793) / 2.0 * n)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(int(n) - 1)).cast("int")
    return clamp(x), clamp(y)


def assign_tiles(df: DataFrame, lon: str, lat: str, zoom: int, spec_col: str | None = None) -> DataFrame:
    """C12 (re-aimed tiling): per tile (and spec) feature count and bounds; one plan for all specs."""
    x, y = quadkey_tile(F.col(lon), F.col(lat), zoom)
    t = df.withColumn("tile_x", x).withColumn("tile_y", y)
    keys = ([spec_col] if spec_col else []) + ["tile_x", "tile_y"]
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"), F.min(lon).alias("lon_min"),
                                F.max(lon).alias("lon_max"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"))


def merge_parts(parts: DataFrame, id_col: str = "id", rel_col: str = "rel", height_col: str = "height",
                geom_col: str = "geom", elevation: float = 50.0, srid: int | None = None) -> DataFrame:
    """Building parts → one row per parent: average height, union of footprints, constant elevation.

    Keeps parts that have a parent relation, a height, or are someone's parent (P9);
    parent = relation else own id (P5); groups whose average height is NULL are
    dropped (A1); the footprint union is G8 (edge-matched parts).
    """
    from geoweave.operators.relational import keep_related

    kept = keep_related(parts, id_col, rel_col, height_col).withColumn(
        "parent", F.coalesce(F.col(rel_col), F.col(id_col)))
    heights = kept.groupBy("parent").agg(F.avg(height_col).alias("average_height")).where(
        F.col("average_height").isNotNull())
    shapes = union_agg(kept.select("parent", G.st_force2d(F.col(geom_col)).alias("g")), "parent", "g", srid)
    return heights.join(shuffled(shapes), "parent").select("parent", "average_height", F.lit(elevation).alias("elevation"),
                                                 G.st_make_valid(F.col("g")).alias("geometry"), "overlap_edges")


def city_triples(building: DataFrame, cityobject: DataFrame, base: str) -> DataFrame:
    """Object-tree attributes of buildings as triples (K3): type, gmlid, parent/root links,
    measured height, LoD0 footprint reference."""
    from geoweave.functions import terms as T
    from geoweave.operators.mapping import map_triples

    b = building.join(cityobject.select("id", "gmlid"), "id")
    s = T.iri(base + "Building/{id}")
    cols = set(b.columns)
    tpl = [(s, "a", T.const_iri(base + "Building")),
           (s, base + "gmlId", T.literal("{gmlid}")),
           (s, base + "measuredHeight", T.literal("{measured_height}", T.XSD + "double")),
           (s, base + "lod0Footprint", T.iri(base + "SurfaceGeometry/{lod0_footprint_id}"))]
    if "building_parent_id" in cols:
        tpl.append((s, base + "hasParent", T.iri(base + "Building/{building_parent_id}")))
    if "building_root_id" in cols:
        tpl.append((s, base + "hasRoot", T.iri(base + "Building/{building_root_id}")))
    return map_triples(b, tpl).distinct()
