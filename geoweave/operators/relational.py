"""Relational operators used by the reference's SQL/mapping texts (P*, J*, A*, U*).

Most are one-liners over Spark built-ins; they exist so the semantics the
reference relies on (PostgreSQL NULL handling, inner-join drops, existence
tests under OR, ...) are written down once and tested.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweave.functions.util import as_col, q
from geoweave.session import cut_lineage

# --- projections / predicates ---------------------------------------------------


def project(df: DataFrame, *keep: str, **exprs) -> DataFrame:
    """Keep columns and add aliased expressions / constants."""
    extra = [(e if isinstance(e, Column) else F.lit(e)).alias(n) for n, e in exprs.items()]
    return df.select(*[F.col(q(c)) for c in keep], *extra)


def select_fields(df: DataFrame, spec: str) -> DataFrame:
    """``-select`` comma list, spaces tolerated (``"id, height,@relations"``)."""
    return df.select(*[F.col(q(c.strip())) for c in spec.split(",") if c.strip()])


def classify_bands(col, bands: Sequence[tuple[float, str]]) -> Column:
    """Half-open bands, highest threshold first: ``[(230,'S'),(35,'H'),(1,'M')]``.

    Values below the last threshold (and NULL) stay NULL — no ``otherwise``.
    """
    c = as_col(col)
    expr = None
    for lo, label in sorted(bands, key=lambda b: -b[0]):
        expr = F.when(c >= lo, F.lit(label)) if expr is None else expr.when(c >= lo, F.lit(label))
    return expr


def first_non_null(*cols) -> Column:
    """Ordered preference (``CASE WHEN a IS NOT NULL THEN a ELSE b``)."""
    return F.coalesce(*[as_col(c) for c in cols])


def with_default(col, value) -> Column:
    """``COALESCE(col, value)``."""
    return F.coalesce(as_col(col), F.lit(value))


def ensure_column(df: DataFrame, name: str, expr: Column, overwrite: bool = True) -> DataFrame:
    """``ADD COLUMN IF NOT EXISTS`` + ``UPDATE … SET`` right after load."""
    if name in df.columns and not overwrite:
        return df
    return df.withColumn(name, expr)


def keep_related(df: DataFrame, id_col: str, rel_col: str, keep_col: str) -> DataFrame:
    """Keep rows with a relation, a value, or that are referenced as someone's relation.

    ``rel IS NOT NULL OR v IS NOT NULL OR id IN (SELECT rel …)``: the ``IN`` leg is an
    existence flag from a left join against the *distinct* referenced ids (a
    semi-join cannot sit under OR at DataFrame level).
    """
    parents = df.where(F.col(rel_col).isNotNull()).select(F.col(rel_col).alias("_pid")).distinct()
    flagged = df.join(parents.withColumn("_is_parent", F.lit(True)), df[id_col] == parents["_pid"], "left")
    return (flagged.where(F.col(rel_col).isNotNull() | F.col(keep_col).isNotNull() | F.col("_is_parent").isNotNull())
            .drop("_pid", "_is_parent"))


# --- joins ------------------------------------------------------------------------


def lookup_join(df: DataFrame, *dims: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Fact ⋈ lookups; AQE broadcasts a lookup whose measured bytes are small and splits hot keys otherwise."""
    out = df
    for d in dims:
        out = out.join(d, on, how)
    return out


def semi_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """``IN (SELECT …)``."""
    return a.join(b, on, "left_semi")


def anti_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Correlated ``NOT EXISTS``.  A NULL key on the left never matches, so it is *kept*."""
    return a.join(b, on, "left_anti")


def fill_from(a: DataFrame, b: DataFrame, on: str | Sequence[str], target: str, source: str) -> DataFrame:
    """``UPDATE a SET target = b.source FROM b WHERE … AND a.target IS NULL``."""
    bb = b.select(*([on] if isinstance(on, str) else list(on)), F.col(source).alias("_src"))
    return a.join(bb, on, "left").withColumn(target, F.coalesce(F.col(target), F.col("_src"))).drop("_src")


def eav_attach(objects: DataFrame, attrs: DataFrame, names: Sequence[str], obj_id: str = "id",
               attr_obj: str = "cityobject_id", attr_name: str = "attrname", attr_value: str = "strval") -> DataFrame:
    """One *inner* join per generic attribute (objects missing one disappear; duplicates multiply)."""
    out = objects
    for n in names:
        a = attrs.where(F.col(attr_name) == n).select(F.col(attr_obj).alias("_oid"), F.col(attr_value).alias(n))
        out = out.join(a, out[obj_id] == a["_oid"], "inner").drop("_oid")
    return out


def bridge_join(a: DataFrame, bridge: DataFrame, left_key: str, bridge_from: str, bridge_to: str,
                b: DataFrame, right_key: str) -> DataFrame:
    """Join through an attribute *value* (``strval = IDENTIFIER_2``)."""
    mid = a.join(bridge, a[left_key] == bridge[bridge_from], "inner")
    return mid.join(b, mid[bridge_to] == b[right_key], "inner")


# --- aggregation / ordering / sets ---------------------------------------------------


def avg_by(df: DataFrame, key: str, value: str, alias: str | None = None) -> DataFrame:
    """A1: ``avg(value)`` per key; groups whose average is NULL are dropped."""
    name = alias or f"avg_{value}"
    return df.groupBy(key).agg(F.avg(value).alias(name)).where(F.col(name).isNotNull())


def collect_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """A5: multimap key → sorted list (used for file groups; the lists are per-driver-type)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(value + "s"))


def with_ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal", num_partitions: int | None = None) -> DataFrame:
    """1-based ``SERIAL``-style ordinal in ``order`` without a single-partition window.

    Range-partition + sort, then add per-partition offsets from a per-partition
    count (one row per partition).  The tagged rows are materialised once: rows and counts must come
    from the same range sampling, which a second evaluation would repeat with other columns and
    other bounds.  Rows with equal ``order`` keys get consecutive ordinals in no stated order.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id())
    tagged = cut_lineage(tagged.withColumn("_pid", F.shiftrightunsigned("_mid", 33)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")  # at most num_partitions rows
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    return out.withColumn(name, F.col("_off") + local + 1).drop("_mid", "_pid", "_off")


def take(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """``LIMIT n`` made deterministic by an explicit order (top-k, no global sort of everything)."""
    return df.orderBy(*order).limit(n)


def union_tagged(parts: Mapping[str, DataFrame], tag_col: str = "tag") -> DataFrame:
    """``UNION ALL`` of sources, each with a constant tag."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [d.withColumn(tag_col, F.lit(t)) for t, d in parts.items()])


def federate(graphs: Mapping[str, DataFrame], distinct_triples: bool = False) -> DataFrame:
    """Merged view over several quad tables; ``g`` = dataset name."""
    u = reduce(lambda a, b: a.unionByName(b), [d.withColumn("g", F.lit(n)) for n, d in graphs.items()])
    if distinct_triples:
        return u.dropDuplicates(["s", "p", "o", "o_kind", "o_dtype", "o_lang"]).withColumn("g", F.lit(None).cast("string"))
    return u


def copy_graphs(quads: DataFrame, names: Sequence[str] | DataFrame, target: str) -> DataFrame:
    """Copy whole graphs into ``target`` (source graphs kept); set semantics."""
    if isinstance(names, DataFrame):
        src = quads.join(names.select(F.col(names.columns[0]).alias("g")), "g", "left_semi")
    else:
        src = quads.where(F.col("g").isin(list(names)))
    return quads.unionByName(src.withColumn("g", F.lit(target))).distinct()


def where_area(df: DataFrame, area: Column, gt: float = 0.0) -> DataFrame:
    """``ST_Area(geom) > x``."""
    return df.where(area > gt)


def where_geom_type(df: DataFrame, geom_col: str, types: Sequence[str]) -> DataFrame:
    """P10: keep rows whose geometry type is one of ``types`` (e.g. POLYGON, MULTIPOLYGON)."""
    return df.where(F.upper(F.col(geom_col)["type"]).isin([t.upper() for t in types]))
