"""RDF terms as Columns.

A *term* Column is ``STRUCT<v STRING, kind STRING, dtype STRING, lang STRING>``
with ``kind`` in ``iri`` / ``bnode`` / ``literal``.  A term whose template
references a NULL column is NULL as a whole, so no triple is produced for it
(R2RML rule).  Templates are parsed once on the driver into a ``concat`` of
literal pieces and (for IRIs, percent-encoded) columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions.pgcompat import iri_encode
from geoweave.functions.util import as_col, q

# Standard W3C / OGC namespace IRIs.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
GEO = "http://www.opengis.net/ont/geosparql#"
DCAT = "http://www.w3.org/ns/dcat#"
DCT = "http://purl.org/dc/terms/"
RDF_TYPE = RDF + "type"

DEFAULT_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL, "geo": GEO, "dcat": DCAT, "dct": DCT}

TERM_SCHEMA = "struct<v:string,kind:string,dtype:string,lang:string>"

_PLACEHOLDER = re.compile(r'\{"([^"]+)"\}|\{([^{}]+)\}|\$\(([^()]+)\)')


def expand_prefix(name: str, prefixes: Mapping[str, str] | None = None) -> str:
    """``ex:thing`` → full IRI; ``a`` → ``rdf:type``; ``<iri>`` and full IRIs unchanged."""
    if name == "a":
        return RDF_TYPE
    if name.startswith("<") and name.endswith(">"):
        return name[1:-1]
    if "://" in name:
        return name
    p = {**DEFAULT_PREFIXES, **(prefixes or {})}
    head, sep, tail = name.partition(":")
    if sep and head in p:
        return p[head] + tail
    return name


def parse_template(template: str) -> list[tuple[str, str]]:
    """Split ``a/{col}/b$(x)`` into ``[('lit','a/'), ('col','col'), ('lit','/b'), ('col','x')]``."""
    out, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            out.append(("lit", template[pos:m.start()]))
        out.append(("col", m.group(1) or m.group(2) or m.group(3)))
        pos = m.end()
    if pos < len(template):
        out.append(("lit", template[pos:]))
    return out


def template_columns(template: str) -> list[str]:
    return [v for k, v in parse_template(template) if k == "col"]


def render(template: str, encode: bool = False) -> Column:
    """Template → string Column; NULL when any referenced column is NULL."""
    pieces = parse_template(template)
    cols = [F.col(q(v)) for k, v in pieces if k == "col"]
    parts = []
    for kind, val in pieces:
        if kind == "lit":
            parts.append(F.lit(val))
        else:
            c = F.col(q(val)).cast("string")
            parts.append(iri_encode(c) if encode else c)
    if not parts:
        return F.lit("")
    # Spark ``concat`` is NULL if any argument is NULL, which is exactly the R2RML rule.
    return F.concat(*parts) if cols else F.lit(template)


def _struct(v: Column, kind: str, dtype: str | None, lang: str | None) -> Column:
    return F.when(v.isNotNull(), F.struct(
        v.alias("v"), F.lit(kind).alias("kind"),
        F.lit(dtype).cast("string").alias("dtype"), F.lit(lang).cast("string").alias("lang"),
    ))


def iri(template: str, prefixes: Mapping[str, str] | None = None) -> Column:
    """IRI term; the constant part may use a prefix (``ex:order/{id}``)."""
    return _struct(render(expand_prefix(template, prefixes), encode=True), "iri", None, None)


def bnode(template: str) -> Column:
    return _struct(F.concat(F.lit("_:"), render(template)), "bnode", None, None)


def literal(template: str | Column, dtype: str | None = None, lang: str | None = None,
            prefixes: Mapping[str, str] | None = None) -> Column:
    """K5: (typed) literal; ``template`` may also be a Column expression."""
    v = template.cast("string") if isinstance(template, Column) else render(template)
    dt = expand_prefix(dtype, prefixes) if dtype else None
    return _struct(v, "literal", dt, lang)


def term(template: str, kind: str = "iri", dtype: str | None = None, lang: str | None = None,
         prefixes: Mapping[str, str] | None = None) -> Column:
    """K1: generic constructor (``kind`` = iri / bnode / literal)."""
    if kind == "iri":
        return iri(template, prefixes)
    if kind == "bnode":
        return bnode(template)
    return literal(template, dtype, lang, prefixes)


def const_iri(name: str, prefixes: Mapping[str, str] | None = None) -> Column:
    return _struct(F.lit(expand_prefix(name, prefixes)), "iri", None, None)


def col_term(col, kind: str = "literal", dtype: str | None = None, lang: str | None = None) -> Column:
    """Term from an existing Column (functions, conditions, computed values)."""
    c = as_col(col)
    if kind == "iri":
        return _struct(c.cast("string"), "iri", None, None)
    return _struct(c.cast("string"), kind, dtype, lang)


def when_term(cond: Column, t: Column) -> Column:
    """K9: emit ``t`` only when ``cond`` is true (NULL term otherwise → no triple)."""
    return F.when(cond, t)
