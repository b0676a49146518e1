"""A table of over a hundred mappings compiled to one scan per source (K3).

The table follows a rule: every row of every source has a type, and every listed column gives a literal, a literal under a
condition, and a link (numbers) or blank node (strings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweave.functions import terms as T
from geoweave.operators import mapping as M
from geoweave.plans.registry import query
from geoweave.plans.tables import read

EX = "https://example.org/kg/"

# source: key columns, number columns, string columns
COLUMNS = {
    "region": (["r_regionkey"], ["r_regionkey"], ["r_name"]),
    "nation": (["n_nationkey"], ["n_nationkey", "n_regionkey"], ["n_name"]),
    "customer": (["c_custkey"], ["c_custkey", "c_nationkey"], ["c_name", "c_mktsegment"]),
    "supplier": (["s_suppkey"], ["s_suppkey", "s_nationkey"], ["s_name"]),
    "part": (["p_partkey"], ["p_partkey", "p_size"], ["p_name", "p_brand", "p_type"]),
    "orders": (["o_orderkey"], ["o_orderkey", "o_custkey"], ["o_orderstatus", "o_orderpriority"]),
    "events": (["event_id"], ["event_id", "user_id"], ["event_type"]),
    "documents": (["doc_id"], ["doc_id", "n_chars"], ["lang", "source"]),
    "labels": (["doc_id"], ["doc_id", "quality", "toxic"], []),
    "pages": (["page_id"], ["page_id"], ["url"]),
    "conversations": (["conv_id", "turn"], ["conv_id", "turn"], ["role"]),
}


def definitions() -> list[tuple]:
    """Rows of ``DEFINITION_SCHEMA``; the first definition of each type is replaced by a later one."""
    out = []
    for table, (keys, numbers, strings) in COLUMNS.items():
        s = f"ex:{table}/" + "/".join("{%s}" % k for k in keys)
        out += [(f"{table}.type", n, table, s, "a", cls, "constant", None, None, None) for n, cls in ((1, "ex:Old"), (2, f"ex:{table}"))]
        for c in numbers + strings:
            number, value = c in numbers, "{%s}" % c
            out.append((f"{table}.{c}", 1, table, s, f"ex:{c}", value, "literal", "xsd:integer" if number else None, None, None))
            out.append((f"{table}.{c}.some", 1, table, s, f"ex:some_{c}", value, "literal", None, None if number else "en",
                        f"{c} % 3 = 1" if number else f"length({c}) > 5"))
            out.append((f"{table}.{c}.link", 1, table, s, f"ex:link_{c}", f"ex:{c}/{value}" if number else f"{c}_{value}",
                        "iri" if number else "bnode", None, None, None))
    return out


def _sql() -> str:
    none, parts = "NULL::VARCHAR", []
    for table, (keys, numbers, strings) in COLUMNS.items():
        s = f"'{EX}{table}/' || " + " || '/' || ".join(f"{k}::VARCHAR" for k in keys)
        parts.append(f"SELECT {none} AS g, {s} AS s, '{T.RDF_TYPE}' AS p, '{EX}{table}' AS o, 'iri' AS o_kind, {none} AS o_dtype, {none} AS o_lang FROM {table}")
        for c in numbers:
            parts += [f"SELECT {none}, {s}, '{EX}{c}', {c}::VARCHAR, 'literal', '{T.XSD}integer', {none} FROM {table} WHERE {c} IS NOT NULL",
                      f"SELECT {none}, {s}, '{EX}some_{c}', {c}::VARCHAR, 'literal', {none}, {none} FROM {table} WHERE {c} % 3 = 1",
                      f"SELECT {none}, {s}, '{EX}link_{c}', '{EX}{c}/' || {c}::VARCHAR, 'iri', {none}, {none} FROM {table} WHERE {c} IS NOT NULL"]
        for c in strings:
            parts += [f"SELECT {none}, {s}, '{EX}{c}', {c}, 'literal', {none}, {none} FROM {table} WHERE {c} IS NOT NULL",
                      f"SELECT {none}, {s}, '{EX}some_{c}', {c}, 'literal', {none}, 'en' FROM {table} WHERE length({c}) > 5",
                      f"SELECT {none}, {s}, '{EX}link_{c}', '_:{c}_' || {c}, 'bnode', {none}, {none} FROM {table} WHERE {c} IS NOT NULL"]
    return " UNION ALL ".join(parts)


@query("map_compiled", _sql())
def map_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mappings of the table over eleven sources; keys are unique, so no DISTINCT is needed."""
    table = spark.createDataFrame(definitions(), M.DEFINITION_SCHEMA)
    return M.compile_mappings(table, {t: read(spark, sf_dir, t) for t in COLUMNS}, distinct=False, prefixes={"ex": EX})
