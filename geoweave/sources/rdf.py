"""N-Triples / N-Quads text ⇄ quad table.

Parsing is one ``regexp_extract`` set per line on the JVM (no Python per row);
lines that do not match go to a reject frame instead of failing the load.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators.graph import Pattern, apply_changes, bgp, changes
from geoweave.operators.mapping import QUAD_COLUMNS, QUAD_SCHEMA
from geoweave.session import cut_lineage, kept, tasks_for

_IRI = r"<[^>]*>"
_BNODE = r"_:[^\s]+"
_LIT = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?'
LINE = rf"^\s*({_IRI}|{_BNODE})\s+({_IRI})\s+({_IRI}|{_BNODE}|{_LIT})\s*({_IRI}|{_BNODE})?\s*\.\s*$"
#: A run of plain characters, or one escape of an RDF literal.
ESCAPES = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"
#: Fixed single-character escapes.
SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit('"'), F.lit('\\"'))
    c = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.replace(c, F.lit("\r"), F.lit("\\r"))


def _unescape(c: Column) -> Column:
    """Decode ``\\uXXXX``, ``\\UXXXXXXXX`` and the single-character escapes; text without a backslash is left as it is."""
    def decode(x: Column) -> Column:
        code = F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0"))
        out = F.when(F.length(x) > 2, F.decode(code, "UTF-32"))
        for letter, char in SHORT.items():
            out = out.when(x == "\\" + letter, F.lit(char))
        return F.when(~x.startswith("\\"), x).otherwise(out.otherwise(F.substring(x, 2, 1)))

    parts = F.transform(F.regexp_extract_all(c, F.lit(ESCAPES), 0), decode)
    return F.when(F.instr(c, "\\") == 0, c).otherwise(F.array_join(parts, ""))


def _node(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def to_nquads(quads: DataFrame) -> DataFrame:
    """Quad table → one ``value`` text line per quad (N-Quads; N-Triples when ``g`` is NULL)."""
    obj = (F.when(F.col("o_kind") == "literal",
                  F.concat(F.lit('"'), _escape(F.col("o")), F.lit('"'),
                           F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang")))
                           .when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_dtype"), F.lit(">")))
                           .otherwise(F.lit(""))))
           .otherwise(_node(F.col("o"))))
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), _node(F.col("g")))).otherwise(F.lit(""))
    return quads.select(F.concat_ws(" ", _node(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), obj)
                        .alias("_t"), graph.alias("_g")).select(F.concat("_t", "_g", F.lit(" .")).alias("value"))


def parse_nquads(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Text lines → (quads, rejects).  Blank lines and ``#`` comments are skipped."""
    t = lines.select(F.col(col).alias("line")).where(
        (F.trim("line") != "") & ~F.trim("line").startswith("#"))
    t = t.withColumn("_ok", F.regexp_like("line", F.lit(LINE)))
    rejects = t.where(~F.col("_ok")).select("line")
    m = t.where("_ok")
    parts = [F.regexp_extract("line", LINE, i) for i in (1, 2, 3, 4)]
    m = m.select(*[p.alias(n) for p, n in zip(parts, ["_s", "_p", "_o", "_g"])])

    def node(c: str) -> Column:
        x = F.col(c)
        return F.when(x.startswith("<"), F.regexp_extract(x, r"^<(.*)>$", 1)).when(x == "", F.lit(None)).otherwise(x)

    o = F.col("_o")
    is_lit = o.startswith('"')
    lex = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    lang = F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)
    dt = F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1)
    quads = m.select(
        node("_g").cast("string").alias("g"), node("_s").alias("s"), node("_p").alias("p"),
        F.when(is_lit, _unescape(lex)).otherwise(node("_o")).alias("o"),
        F.when(is_lit, F.lit("literal")).when(o.startswith("_:"), F.lit("bnode")).otherwise(F.lit("iri")).alias("o_kind"),
        F.when(is_lit & (dt != ""), dt).alias("o_dtype"),
        F.when(is_lit & (lang != ""), lang).alias("o_lang"),
    )
    return quads.select(*QUAD_COLUMNS), rejects


def read_nquads(spark: SparkSession, path: str, extensions=(".nq", ".nt")) -> tuple[DataFrame, DataFrame]:
    """Bulk-load every ``.nq`` / ``.nt`` file under ``path`` (other extensions skipped)."""
    glob = "{" + ",".join("*" + e for e in extensions) + "}"
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return parse_nquads(lines)


def write_nquads(quads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the quad table as N-Quads text files (one part file per partition)."""
    to_nquads(quads).write.mode(mode).text(path)


def _by_predicate(quads: DataFrame, spread: int) -> DataFrame:
    """A predicate is spread over ``spread`` writers or more by subject: one that holds a third of all quads is not one task's work."""
    n = tasks_for(quads)  # a writer sorts its quads by predicate
    return quads.select(*QUAD_COLUMNS).repartition(n, F.col("p"), F.pmod(F.xxhash64("s"), F.lit(max(spread, n))))


def write_quad_table(quads: DataFrame, path: str, mode: str = "overwrite", spread: int = 16) -> None:
    """Persist the quad table as parquet partitioned by predicate: a graph pattern with a constant
    predicate then reads only that predicate's directory (partition pruning), and ``g``/``s``/``o``
    filters are pushed into the parquet scan."""
    _by_predicate(quads, spread).write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("p").parquet(path)


def read_quad_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a quad table written by :func:`write_quad_table` (columns in the usual order)."""
    return spark.read.schema(QUAD_SCHEMA).parquet(path).where(F.col("s").isNotNull()).select(*QUAD_COLUMNS)


def change_quad_table(spark: SparkSession, path: str, changed: DataFrame, spread: int = 16) -> list[str]:
    """Apply ``changed`` (:func:`geoweave.operators.graph.changes`) to a stored quad table; the predicates rewritten.

    Copy on write by predicate: only the folders of predicates that ``changed`` names are read and replaced, all others keep their
    files.  The new files are staged and take the place of the old ones when the job commits, so a lost executor costs
    a retry.  A replaced folder also holds one row without a subject, which readers skip: a predicate
    whose last quad goes is so replaced as well.  The list on the driver has one entry a predicate folder.  One writer at a time.
    """
    changed = cut_lineage(changed)
    touched = sorted(r.p for r in changed.select("p").distinct().collect())
    if not touched:
        return []
    old = read_quad_table(spark, path).where(F.col("p").isin(touched))
    emptied = spark.createDataFrame([(p,) for p in touched], "p string").select(
        *[F.col(c) if c == "p" else F.lit(None).cast("string").alias(c) for c in QUAD_COLUMNS])
    new = kept(apply_changes(old, changed, tasks_for(old))).unionByName(emptied)
    (_by_predicate(new, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("p").parquet(path))
    return touched


def update_quad_table(spark: SparkSession, path: str, delete: Sequence[Pattern], insert: Sequence[Pattern], where: Sequence[Pattern],
                      prefixes: Mapping[str, str] | None = None, graph: str | None = None) -> list[str]:
    """Q8 on a stored table: ``DELETE {…} INSERT {…} WHERE {…}``, touching only the changed predicates."""
    bindings = bgp(read_quad_table(spark, path), where, prefixes)
    return change_quad_table(spark, path, changes(bindings, delete, insert, prefixes, graph)) if delete or insert else []


def run_rules_stored(spark: SparkSession, path: str, rules: Sequence[Mapping], prefixes: Mapping[str, str] | None = None) -> list[list[str]]:
    """Q9 on a stored table: each rule once, in order; every rule reads what the one before it left."""
    return [update_quad_table(spark, path, r.get("delete", []), r.get("insert", []), r["where"], prefixes, r.get("graph"))
            for r in rules]


def copy_graphs_stored(spark: SparkSession, path: str, names: Sequence[str], target: str) -> list[str]:
    """U3 on a stored table: copy whole graphs into ``target``."""
    quads = read_quad_table(spark, path).where(F.col("g").isin(list(names)))
    return change_quad_table(spark, path, quads.withColumn("g", F.lit(target)).withColumn("added", F.lit(True)))


def remove_nodes_stored(spark: SparkSession, path: str, nodes: DataFrame) -> list[str]:
    """D9's removal on a stored table: every quad with one of ``nodes`` (first column) as subject or as IRI object."""
    quads, node = read_quad_table(spark, path), nodes.select(F.col(nodes.columns[0]).alias("_node")).distinct()
    out = quads.join(node, F.col("s") == F.col("_node"), "left_semi")
    linked = quads.where("o_kind = 'iri'").join(node, F.col("o") == F.col("_node"), "left_semi")
    return change_quad_table(spark, path, out.unionByName(linked).withColumn("added", F.lit(False)))
