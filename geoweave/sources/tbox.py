"""Ontology-definition tables → OWL triples (S21) *[gap]*.

The reference hands its ``*.csv`` TBox files to an external generator; the
column layout below (``source, type, target, relation, domain, range, comment``)
and the fixed template set are our definition of that step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions import terms as T
from geoweave.operators.mapping import map_triples

OWL_CLASS = T.OWL + "Class"
OWL_OBJ = T.OWL + "ObjectProperty"
OWL_DATA = T.OWL + "DatatypeProperty"


def tbox_to_triples(df: DataFrame, base: str) -> DataFrame:
    """Rows ``(source, type, target, relation, domain, range, comment)`` → triples.

    type ``Class`` → ``owl:Class`` (+ ``rdfs:subClassOf target`` when relation is ``IS-A``);
    ``Object Property`` / ``Data Property`` → property declarations with domain and range.
    """
    iri = lambda c: T.col_term(F.when(F.col(c).isNotNull(), F.concat(F.lit(base), F.col(c))), "iri")
    kind = F.lower(F.trim("type"))
    decl = (F.when(kind == "class", F.lit(OWL_CLASS)).when(kind == "object property", F.lit(OWL_OBJ))
            .when(kind == "data property", F.lit(OWL_DATA)))
    is_a = F.upper(F.trim("relation")) == "IS-A"
    rng = F.when(kind == "data property", F.concat(F.lit(T.XSD), F.col("range"))).otherwise(
        F.concat(F.lit(base), F.col("range")))
    return map_triples(df, [
        (iri("source"), "a", T.col_term(decl, "iri")),
        (iri("source"), T.RDFS + "subClassOf", T.when_term(is_a & (kind == "class"), iri("target"))),
        (iri("source"), T.RDFS + "domain", iri("domain")),
        (iri("source"), T.RDFS + "range", T.col_term(F.when(F.col("range").isNotNull(), rng), "iri")),
        (iri("source"), T.RDFS + "comment", T.col_term(F.col("comment"), "literal")),
    ]).distinct()
