"""Relational → triples (K2, K3, K4, K6, K7, K9, K10, K12) and the function registry.

The quad table is ``g, s, p, o, o_kind, o_dtype, o_lang`` (all strings; ``g`` is
NULL for the default graph).  Two equivalent physical forms of a mapping:

* ``mode="materialise"`` — one scan, ``explode(array(struct …))``: best when every
  triple is written out.
* ``mode="virtual"`` — ``unionByName`` of one projection per template with a
  literal predicate: a later filter on ``p`` removes whole branches and prunes
  their columns at the scan (what a query-rewriting mapper does).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweave.functions import pgcompat, terms
from geoweave.functions.util import as_col

QUAD_COLUMNS = ["g", "s", "p", "o", "o_kind", "o_dtype", "o_lang"]
QUAD_SCHEMA = "g string, s string, p string, o string, o_kind string, o_dtype string, o_lang string"

TripleTemplate = tuple[Column, str, Column]


def _quad_cols(s: Column, p: str, o: Column, g: str | Column | None) -> list[Column]:
    gcol = g if isinstance(g, Column) else F.lit(g).cast("string")
    return [gcol.alias("g"), s.getField("v").alias("s"), F.lit(p).alias("p"),
            o.getField("v").alias("o"), o.getField("kind").alias("o_kind"),
            o.getField("dtype").alias("o_dtype"), o.getField("lang").alias("o_lang")]


def map_triples(df: DataFrame, templates: Sequence[TripleTemplate], graph: str | Column | None = None,
                mode: str = "materialise", prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """K2: every source row emits every template triple whose terms are all non-NULL."""
    tpl = [(s, terms.expand_prefix(p, prefixes), o) for s, p, o in templates]
    if mode == "virtual":
        branches = [df.select(*_quad_cols(s, p, o, graph)).where(F.col("s").isNotNull() & F.col("o").isNotNull())
                    for s, p, o in tpl]
        return reduce(lambda a, b: a.unionByName(b), branches)
    gcol = graph if isinstance(graph, Column) else F.lit(graph).cast("string")
    packed = F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in tpl])
    t = df.select(gcol.alias("g"), F.explode(packed).alias("t"))
    return (t.where(F.col("t.s").isNotNull() & F.col("t.o").isNotNull())
             .select("g", F.col("t.s.v").alias("s"), F.col("t.p").alias("p"), F.col("t.o.v").alias("o"),
                     F.col("t.o.kind").alias("o_kind"), F.col("t.o.dtype").alias("o_dtype"),
                     F.col("t.o.lang").alias("o_lang")))


def map_many(mappings: Sequence[tuple[DataFrame, Sequence[TripleTemplate]]], graph: str | None = None,
             mode: str = "materialise", distinct: bool = True) -> DataFrame:
    """K3: union of many mappings (each ``(source_df, templates)``); set semantics on request."""
    out = reduce(lambda a, b: a.unionByName(b), [map_triples(df, t, graph, mode) for df, t in mappings])
    return out.distinct() if distinct else out


DEFINITION_SCHEMA = ("mapping_id string, seq int, source string, subject string, predicate string, object string, "
                     "kind string, dtype string, lang string, condition string")


def compile_mappings(definitions: DataFrame, sources: Mapping[str, DataFrame], graph: str | None = None,
                     distinct: bool = True, prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """K3: a table of mappings (``DEFINITION_SCHEMA``, one row a triple template) → quads, with one scan per source.

    The last definition of a ``mapping_id`` wins (K4).  Definitions are the program, not the data: they are read by the driver.
    All templates over one source become one generate over the columns they name, each distinct subject rendered once.
    ``source`` names an entry of ``sources`` or is a SELECT; ``kind`` is ``iri``, ``literal``, ``bnode`` or ``constant`` (an IRI without
    columns); ``condition`` is an SQL condition on the source's row, NULL for none.  No definitions: no quads.  A definition
    without source, subject, predicate or object raises.
    """
    by_source: dict[str, list] = {}
    for d in merge_mappings(definitions).orderBy("source", "mapping_id").collect():
        if None in (d["source"], d["subject"], d["predicate"], d["object"]):
            raise ValueError(f"incomplete mapping {d['mapping_id']}")
        by_source.setdefault(d["source"], []).append(d)
    parts = []
    for source, defs in by_source.items():
        df = sources[source] if source in sources else definitions.sparkSession.sql(source)
        subjects = {t: f"_subject_{i}" for i, t in enumerate(dict.fromkeys(d["subject"] for d in defs))}

        def obj(d) -> Column:
            if d["kind"] == "constant":
                t = terms.const_iri(d["object"], prefixes)
            else:
                t = terms.term(d["object"], d["kind"], d["dtype"], d["lang"], prefixes)
            return terms.when_term(F.expr(d["condition"]), t) if d["condition"] else t

        rendered = df.select("*", *[(terms.bnode(t[2:]) if t.startswith("_:") else terms.iri(t, prefixes)).alias(c)
                                    for t, c in subjects.items()])
        parts.append(map_triples(rendered, [(F.col(subjects[d["subject"]]), d["predicate"], obj(d)) for d in defs], graph, prefixes=prefixes))
    if not parts:
        return definitions.sparkSession.createDataFrame([], QUAD_SCHEMA)
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.distinct() if distinct else out


def merge_mappings(versions: DataFrame, id_col: str = "mapping_id", seq_col: str = "seq") -> DataFrame:
    """Mapping definitions merged by id — the last (highest ``seq``) definition wins.

    ``max_by`` over a struct is a hash aggregate with map-side partial merge, so a
    hot id never funnels its whole group into one task.
    """
    other = [c for c in versions.columns if c not in (id_col, seq_col)]
    packed = F.struct(*[F.col(c) for c in [seq_col, *other]])
    return (versions.groupBy(id_col).agg(F.max_by(packed, F.col(seq_col)).alias("_w"))
            .select(id_col, *[F.col(f"_w.{c}").alias(c) for c in [seq_col, *other]]))


def last_wins_window(versions: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """A7 in its window form (kept for callers that need every column untouched)."""
    w = Window.partitionBy(id_col).orderBy(F.col(seq_col).desc())
    return versions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def canonicalise(quads: DataFrame, canon: DataFrame, iri_col: str = "iri", canonical_col: str = "canonical") -> DataFrame:
    """K6: replace IRIs in subject and (IRI) object position by their canonical IRI.

    ``canon`` has one row per IRI (dimension-sized); both lookups are equi-joins
    that AQE can broadcast when the mapping table is small.
    """
    cm = canon.select(F.col(iri_col).alias("_iri"), F.col(canonical_col).alias("_canon"))
    by_s = quads.join(cm, quads["s"] == cm["_iri"], "left").withColumn("s", F.coalesce("_canon", "s")).drop("_iri", "_canon")
    # objects are where hot keys live (one class IRI may be the object of a third of all triples)
    cm_o = cm.select(F.col("_iri").alias("o"), F.lit("iri").alias("o_kind"), F.col("_canon").alias("_ocanon"))
    by_o = by_s.join(cm_o, ["o", "o_kind"], "left")
    return by_o.withColumn("o", F.coalesce("_ocanon", "o")).drop("_ocanon").select(*QUAD_COLUMNS)


def spatial_literal(wkt: Column, srid: Column | int | None = None) -> Column:
    """``geo:wktLiteral`` term, CRS-prefixed when an SRID is given."""
    if srid is None:
        text = wkt
    else:
        s = srid if isinstance(srid, Column) else F.lit(srid)
        text = F.concat(F.lit("<http://www.opengis.net/def/crs/EPSG/0/"), s.cast("string"), F.lit("> "), wkt)
    return terms.col_term(text, "literal", terms.GEO + "wktLiteral")


# --- function registry (E1) and rule documents (K7, K9, K10) ----------------------

FunctionBuilder = Callable[..., Column]

# Function IRIs of the mapping-rule vocabularies used by the examples.
GREL = "http://users.ugent.be/~bjdmeest/function/grel.ttl#"
IDLAB = "https://w3id.org/imec/idlab/function#"

REGISTRY: dict[str, FunctionBuilder] = {}


def register_function(name: str, builder: FunctionBuilder) -> None:
    """Register a Column builder (or a pandas UDF) under a full function IRI."""
    REGISTRY[name] = builder


def _string_replace(**kw) -> Column:
    find = kw["p_string_find"]
    repl = kw.get("p_string_replace", "")
    return pgcompat.string_replace(kw["valueParameter"], find if isinstance(find, str) else str(find), repl)


for _name, _fn in {
    GREL + "string_trim": lambda **kw: pgcompat.string_trim(kw["valueParameter"]),
    GREL + "string_replace": _string_replace,
    GREL + "boolean_not": lambda **kw: ~kw["bool_b"],
    GREL + "toUpperCase": lambda **kw: F.upper(kw["valueParameter"]),
    GREL + "toLowerCase": lambda **kw: F.lower(kw["valueParameter"]),
    IDLAB + "isNull": lambda **kw: kw["str"].isNull(),
    IDLAB + "equal": lambda **kw: kw["str"] == kw["otherStr"],
}.items():
    register_function(_name, _fn)


class RuleDocument:
    """K7: a rule document in YARRRML *long form* (a plain dict), compiled to Columns.

    Accepted shape (the normalised form)::

        {"prefixes": {...},
         "mappings": {name: {"s": "tmpl" | {"value": "tmpl"},
                             "condition": fn?,                       # mapping level
                             "po": [{"p": "tmpl", "o": obj, "condition": fn?}, [p, o], ...]}}}

    ``obj`` is ``"tmpl"`` (``~iri`` suffix → IRI), ``{"value": tmpl, "datatype": dt}``,
    ``{"function": iri, "parameters": [...]}``, or a list of
    ``{"mapping": name, "condition": fn?}`` (object = the other mapping's subject
    on the same row, J13).  Anything else is rejected (trap T11).
    """

    def __init__(self, doc: Mapping, registry: Mapping[str, FunctionBuilder] | None = None):
        self.prefixes = {k: str(v) for k, v in (doc.get("prefixes") or {}).items()}
        self.mappings = dict(doc.get("mappings") or {})
        self.registry = registry or REGISTRY
        for name, m in self.mappings.items():
            if not isinstance(m, Mapping) or "s" not in m:
                raise ValueError(f"mapping {name!r} needs a subject")

    # templates use $(col); values that are pure constants are prefixed names or IRIs
    def _subject(self, name: str) -> Column:
        s = self.mappings[name]["s"]
        tmpl = s["value"] if isinstance(s, Mapping) else s
        if not isinstance(tmpl, str):
            raise ValueError(f"subject of {name!r} must be a string template")
        return terms.iri(tmpl, self.prefixes)

    def _value(self, v) -> Column:
        if isinstance(v, Mapping) and "function" in v:
            return self._function(v)
        if isinstance(v, str) and terms.template_columns(v):
            return terms.render(v)
        return F.lit(v)

    def _function(self, spec: Mapping) -> Column:
        fname = terms.expand_prefix(spec["function"], self.prefixes)
        if fname not in self.registry:
            raise KeyError(f"function {fname} is not registered")
        kwargs = {}
        for prm in spec.get("parameters", []):
            if isinstance(prm, (list, tuple)):
                key, val = prm
            else:
                key, val = prm["parameter"], prm["value"]
            local = terms.expand_prefix(key, self.prefixes).rsplit("#", 1)[-1].rsplit("/", 1)[-1]
            # constant strings stay Python values (regexes, replacements); templates/functions → Columns
            is_const = isinstance(val, str) and not terms.template_columns(val)
            kwargs[local] = val if is_const else self._value(val)
        return self.registry[fname](**kwargs)

    def _object(self, o) -> list[tuple[Column, Column | None]]:
        """Object spec → list of (term Column, condition Column or None)."""
        if isinstance(o, list):
            out = []
            for item in o:
                if isinstance(item, Mapping) and "mapping" in item:
                    cond = self._function(item["condition"]) if "condition" in item else None
                    out.append((self._subject(item["mapping"]), cond))
                else:
                    out.extend(self._object(item))
            return out
        if isinstance(o, Mapping) and "function" in o:
            return [(terms.col_term(self._function(o), "literal"), None)]
        if isinstance(o, Mapping) and "value" in o:
            dt = o.get("datatype")
            if o.get("type") == "iri":
                return [(terms.iri(o["value"], self.prefixes), None)]
            return [(self._literal(o["value"], dt, o.get("language")), None)]
        if isinstance(o, str):
            if o.endswith("~iri"):
                return [(terms.iri(o[:-4], self.prefixes), None)]
            if not terms.template_columns(o) and self._names_iri(o):
                return [(terms.const_iri(o, self.prefixes), None)]
            return [(self._literal(o), None)]
        raise ValueError(f"unsupported object {o!r}")

    def _names_iri(self, o: str) -> bool:
        """A constant is an IRI if it is ``a``, ``<…>``, has a declared prefix or a scheme; any other is a literal."""
        head, colon, rest = o.partition(":")
        return o == "a" or (o.startswith("<") and o.endswith(">")) or bool(colon) and (
            head in self.prefixes or head in terms.DEFAULT_PREFIXES or rest.startswith("//") or head in ("urn", "mailto"))

    def _literal(self, text: str, datatype: str | None = None, language: str | None = None) -> Column:
        return terms.literal(text, datatype, language, self.prefixes)

    def _typed(self, o, tag: str) -> list[tuple[Column, Column | None]]:
        """Third element of ``[p, o, tag]``: ``xx~lang`` is a language, anything else a datatype."""
        if tag.endswith("~lang"):
            return [(self._literal(o, None, tag[:-5]), None)]
        return [(self._literal(o, tag), None)]

    def templates(self) -> list[TripleTemplate]:
        out: list[TripleTemplate] = []
        for name, m in self.mappings.items():
            s = self._subject(name)
            mcond = self._function(m["condition"]) if "condition" in m else None
            for po in m.get("po", []):
                if isinstance(po, (list, tuple)):
                    p, o, pcond = po[0], po[1], None
                else:
                    p, o = po["p"], po["o"]
                    pcond = self._function(po["condition"]) if "condition" in po else None
                pred = terms.expand_prefix(p, self.prefixes)
                tag = po[2] if isinstance(po, (list, tuple)) and len(po) > 2 else None
                for oterm, ocond in self._typed(o, tag) if tag else self._object(o):
                    conds = [c for c in (mcond, pcond, ocond) if c is not None]
                    if conds:
                        oterm = terms.when_term(reduce(lambda a, b: a & b, conds), oterm)
                    out.append((s, pred, oterm))
        return out


def map_rules(df: DataFrame, doc: Mapping | RuleDocument, graph: str | None = None,
              mode: str = "materialise") -> DataFrame:
    """Apply a rule document to a source DataFrame (one scan)."""
    rd = doc if isinstance(doc, RuleDocument) else RuleDocument(doc)
    return map_triples(df, rd.templates(), graph, mode)


def null_if_empty(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Delimited-source convention: ``''`` → NULL (with whitespace kept otherwise)."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.select(*[F.when(as_col(c) != "", as_col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
