"""Iterative operators: RDFS closure (Q10) and dataset reference closure.

Both iterate semi-naively (only the last round's new facts are joined again),
stop on an empty delta, cut lineage with a reliable checkpoint every round and
carry a depth guard.  Only the *schema* part of RDFS (class / property
hierarchies) iterates; instance data is touched by a fixed number of joins
against the closed schema, so the loop never re-scans the big tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions.terms import RDF_TYPE, RDFS
from geoweave.operators.mapping import QUAD_COLUMNS
from geoweave.session import cut_lineage

SUBCLASS = RDFS + "subClassOf"
SUBPROP = RDFS + "subPropertyOf"
DOMAIN = RDFS + "domain"
RANGE = RDFS + "range"
CLASS = RDFS + "Class"
RESOURCE = RDFS + "Resource"


def transitive_closure(edges: DataFrame, src: str = "s", dst: str = "o") -> DataFrame:
    """Semi-naive transitive closure of a binary relation (distinct pairs).

    Every round adds pairs or ends, and the pairs of a finite node set are finite, so cycles end too.
    """
    known = cut_lineage(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    delta = known
    while not delta.isEmpty():
        step = (delta.join(known.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
                .select("a", F.col("c").alias("b")).distinct())
        delta = cut_lineage(step.join(known, ["a", "b"], "left_anti"))
        known = cut_lineage(known.unionByName(delta))
    return known.select(F.col("a").alias(src), F.col("b").alias(dst))


def _triple(s, p, o, kind="iri") -> list:
    return [F.lit(None).cast("string").alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"),
            F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"),
            F.lit(None).cast("string").alias("o_lang")]


def entailments(schema: DataFrame, sc: DataFrame, sp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a property and a class entail, one row each: ``p, supers, domains, ranges`` and ``c, above``.

    Both follow the size of the schema, not of the data.
    """
    dom = schema.where(F.col("p") == DOMAIN).select(F.col("s").alias("q"), F.col("o").alias("dc"))
    rng = schema.where(F.col("p") == RANGE).select(F.col("s").alias("q"), F.col("o").alias("rc"))
    named = sp.select(F.col("s").alias("p")).unionByName(dom.select(F.col("q").alias("p"))).unionByName(rng.select(F.col("q").alias("p")))
    pairs = sp.select(F.col("s").alias("p"), F.col("o").alias("q")).unionByName(named.select("p", F.col("p").alias("q"))).distinct()
    props = (pairs.join(dom, "q", "left").join(rng, "q", "left").groupBy("p")
             .agg(F.collect_set(F.when(F.col("q") != F.col("p"), F.col("q"))).alias("supers"),
                  F.collect_set("dc").alias("domains"), F.collect_set("rc").alias("ranges")))
    above = sc.where(F.col("o") != RESOURCE).groupBy(F.col("s").alias("c")).agg(F.collect_set("o").alias("above"))
    return cut_lineage(props), cut_lineage(above)


def schema_closure(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schema triples ``s, p, o`` of the default graph and the closed subPropertyOf relation.

    A property below subClassOf, subPropertyOf, domain or range makes schema triples of its own triples; these can put
    further properties there, so both are repeated until nothing is new.  Without such a property the data is read once.
    """
    terms = [SUBCLASS, SUBPROP, DOMAIN, RANGE]
    default = base.where(F.col("g").isNull()).select("s", "p", "o", "o_kind")
    schema = cut_lineage(default.where(F.col("p").isin(terms)).select("s", "p", "o").distinct())
    lifted = None
    while True:
        sp = transitive_closure(schema.where(F.col("p") == SUBPROP).select("s", "o"))
        lifts = sp.where(F.col("o").isin(terms) & (F.col("s") != F.col("o")))
        lifts = cut_lineage(lifts if lifted is None else lifts.join(lifted, ["s", "o"], "left_anti"))
        if lifts.isEmpty():
            return schema, sp
        new = (default.where(F.col("o_kind") != "literal").join(lifts.select(F.col("s").alias("p"), F.col("o").alias("q")), "p")
               .select("s", F.col("q").alias("p"), "o").distinct())
        schema = cut_lineage(schema.unionByName(new).distinct())
        lifted = lifts if lifted is None else cut_lineage(lifted.unionByName(lifts))


def rdfs_closure(quads: DataFrame) -> DataFrame:
    """Q10: RDFS entailment over the default graph (set semantics); quads of named graphs stay as they are.

    Rules: subClassOf / subPropertyOf transitivity; property inheritance;
    domain and range typing; type propagation along subClassOf; every class
    (node of a subClassOf triple or object of an ``rdf:type``) is a
    ``rdfs:Class``, its own subclass and a subclass of ``rdfs:Resource``.
    ``x rdf:type rdfs:Resource`` is not materialised (with two explicit triples
    ``a a A . A subClassOf B`` the result has 9 triples).

    Schema triples that follow from sub-properties of these four are part of the schema (``schema_closure``).

    The input is read twice (and once more for each round of such sub-properties): for its schema triples, and for a pass that expands each quad into the
    rows it entails through two schema-sized lookups; one final ``distinct`` combines map-side, so
    the many equal class rows never travel.
    """
    base = quads.select(*QUAD_COLUMNS)
    schema, sp = schema_closure(base)
    sc = transitive_closure(schema.where(F.col("p") == SUBCLASS).select("s", "o"))
    props, above = entailments(schema, sc, sp)

    none = F.lit(None).cast("string")
    quad = lambda g, s, p, o, kind, dtype, lang: F.struct(
        g.alias("g"), s.alias("s"), p.alias("p"), o.alias("o"), kind.alias("o_kind"), dtype.alias("o_dtype"), lang.alias("o_lang"))
    iri = F.lit("iri")
    typing = lambda x, c: quad(none, x, F.lit(RDF_TYPE), c, iri, none, none)
    rows = base.join(props, "p", "left")
    default, listed = F.col("g").isNull(), lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    own = quad(*[F.col(c) for c in QUAD_COLUMNS])
    more = F.concat(
        F.transform(listed("supers"), lambda q: quad(F.col("g"), F.col("s"), q, F.col("o"), F.col("o_kind"), F.col("o_dtype"), F.col("o_lang"))),
        F.transform(listed("domains"), lambda c: typing(F.col("s"), c)),
        F.when(F.col("o_kind") != "literal", F.transform(listed("ranges"), lambda c: typing(F.col("o"), c))).otherwise(
            F.filter(F.array(own), lambda x: F.lit(False))))
    step = rows.select(F.inline(F.when(default, F.concat(F.array(own), more)).otherwise(F.array(own))))
    step = step.join(above.select(F.lit(RDF_TYPE).alias("p"), F.col("c").alias("o"), "above"), ["p", "o"], "left")
    a_type = F.col("g").isNull() & (F.col("p") == RDF_TYPE)
    a_class = a_type & ~F.col("o").isin(CLASS, RESOURCE)
    empty = F.filter(F.array(own), lambda x: F.lit(False))
    out = step.select(F.inline(F.concat(
        F.array(own),
        F.when(a_type, F.transform(listed("above"), lambda c: typing(F.col("s"), c))).otherwise(empty),
        F.when(a_class, F.array(typing(F.col("o"), F.lit(CLASS)), quad(none, F.col("o"), F.lit(SUBCLASS), F.col("o"), iri, none, none),
                                quad(none, F.col("o"), F.lit(SUBCLASS), F.lit(RESOURCE), iri, none, none))).otherwise(empty))))
    nodes = (sc.select(F.col("s").alias("c")).unionByName(sc.select(F.col("o").alias("c"))).distinct().where(~F.col("c").isin(CLASS, RESOURCE)))
    result = out
    for d in (sc.select(*_triple(F.col("s"), SUBCLASS, F.col("o"))), sp.select(*_triple(F.col("s"), SUBPROP, F.col("o"))),
              nodes.select(*_triple(F.col("c"), RDF_TYPE, F.lit(CLASS))), nodes.select(*_triple(F.col("c"), SUBCLASS, F.col("c"))),
              nodes.select(*_triple(F.col("c"), SUBCLASS, F.lit(RESOURCE)))):
        result = result.unionByName(d)
    return result.select(*QUAD_COLUMNS).distinct()


def reference_closure(edges: DataFrame, names: DataFrame, root: str | None, src: str = "name",
                      dst: str = "ref", max_depth: int | None = None) -> DataFrame:
    """Datasets to load for ``root`` with their level (max depth from the root).

    If a dataset is called ``root``: it and everything it references
    (transitively); otherwise every dataset.  Load order = level descending
    (children first).  A reference to an unknown dataset or a cycle raises.
    """
    names = names.select(F.col(names.columns[0]).alias("name")).distinct()
    # the edge table is joined in every round: materialise it once
    e = cut_lineage(edges.select(F.col(src).alias("name"), F.col(dst).alias("ref")).distinct())
    missing = e.join(names.withColumnRenamed("name", "ref"), "ref", "left_anti")
    if not missing.isEmpty():
        bad = [r["ref"] for r in missing.select("ref").limit(5).collect()]
        raise ValueError(f"unknown referenced datasets: {bad}")
    roots = names.where(F.col("name") == root) if root is not None else names.limit(0)
    if roots.isEmpty():
        roots = names
    frontier = cut_lineage(roots.select("name", F.lit(0).alias("level")))
    levels = frontier
    guard = max_depth  # a cycle guard: no acyclic path is longer than the number of datasets
    depth = 0
    while True:
        nxt = (frontier.join(e, "name").select(F.col("ref").alias("name"), (F.col("level") + 1).alias("level"))
               .groupBy("name").agg(F.max("level").alias("level")))
        nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        depth += 1
        if guard is None:
            guard = names.count() + 1
        if depth > guard:
            raise ValueError("cycle in dataset references")
        levels = cut_lineage(levels.unionByName(nxt))
        frontier = nxt
    return levels.groupBy("name").agg(F.max("level").alias("level"))
