"""Catalogue and N-Quads queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators import catalog as C
from geoweave.plans.kg import EX, order_sql, tpch_quads, union_sql
from geoweave.plans.registry import query
from geoweave.plans.tables import read
from geoweave.session import cut_lineage
from geoweave.sources.rdf import parse_nquads, to_nquads

NOW1 = "2024-01-01T00:00:00"
NOW2 = "2024-02-01T00:00:00"
EMPTY_QUADS = "g string, s string, p string, o string, o_kind string, o_dtype string, o_lang string"


def _datasets(spark: SparkSession, sf_dir: str, version: int) -> tuple[DataFrame, DataFrame]:
    """One dataset per document source; subsets = its languages; description carries the version."""
    docs = read(spark, sf_dir, "documents", "source", "lang")
    ds = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("source").alias("name"),
        F.concat(F.lit(f"v{version}: "), F.col("n").cast("string"), F.lit(" documents")).alias("description"))
    subs = docs.where(F.col("lang").isNotNull()).select(F.col("source").alias("name"), F.col("lang").alias("subset")).distinct()
    return ds, subs


def _load_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([], EMPTY_QUADS)
    for version, now in ((1, NOW1), (2, NOW2)):
        ds, subs = _datasets(spark, sf_dir, version)
        # each update reads the previous table several times: cut lineage between updates
        q = cut_lineage(C.upsert_catalog(q, ds, now, EX))
        q = cut_lineage(C.upsert_subsets(q, subs, now, EX))
    return q


CATALOG_SQL = f"""
SELECT source AS title, 'v2: ' || CAST(count(*) AS VARCHAR) || ' documents' AS description,
       '{NOW1}' AS issued, '{NOW2}' AS last_modified, 2::BIGINT AS n_versions,
       count(DISTINCT lang) AS n_subsets
FROM documents GROUP BY source
"""


@query("catalog_upsert_twice", CATALOG_SQL)
def catalog_upsert_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads — issued kept, description replaced, modified history grows, links replaced."""
    return C.catalog_table(_load_twice(spark, sf_dir))


@query("catalog_remove", CATALOG_SQL.replace("GROUP BY source", "WHERE source NOT IN ('src1', 'src2', 'src3') GROUP BY source"))
def catalog_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove three datasets (entries, subsets, links) after two loads."""
    return C.catalog_table(C.remove_from_catalog(_load_twice(spark, sf_dir), ["src1", "src2", "src3"]))


@query("nquads_roundtrip", union_sql(order_sql(f"'{EX}graph/orders'")))
def nquads_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15 → S14: mapped orders (named graph) to N-Quads text and parsed back, lossless."""
    text = to_nquads(tpch_quads(spark, sf_dir, ("orders",), mode="materialise", graphs=True))
    quads, _rejects = parse_nquads(text)
    return quads


@query("services_clone", f"""
SELECT '{EX}graph/clone' AS g, '{EX}doc/' || CAST(doc_id AS VARCHAR) AS s, '{EX}lang' AS p, lang AS o,
       'literal' AS o_kind, NULL::VARCHAR AS o_dtype, NULL::VARCHAR AS o_lang
FROM documents WHERE source IN ('src1', 'src2') AND lang IS NOT NULL
""")
def services_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register one graph service per dataset, look the services up in the catalogue,
    and clone the graphs of two datasets into a target graph (U3)."""
    from geoweave.functions import terms as T
    from geoweave.operators.mapping import map_triples

    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "source")
    ds, _subs = _datasets(spark, sf_dir, 1)
    q = cut_lineage(C.upsert_catalog(spark.createDataFrame([], EMPTY_QUADS), ds, NOW1, EX))
    services = ds.select("name", F.lit("graph").alias("type"), F.concat("name", F.lit("-graph")).alias("title"),
                         F.concat(F.lit(EX + "graph/"), F.col("name")).alias("url"))
    q = cut_lineage(C.refresh_services(q, services, EX))
    data = map_triples(docs, [(T.iri(EX + "doc/{doc_id}"), EX + "lang", T.literal("{lang}"))],
                       graph=F.concat(F.lit(EX + "graph/"), F.col("source")))
    cloned = C.clone_graphs(q.unionByName(data), ["src1", "src2"], EX + "graph/clone")
    return cloned.where(F.col("g") == EX + "graph/clone")
