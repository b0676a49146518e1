from pyspark.sql import functions as F

from geoweave.functions import terms as T
from geoweave.operators import mapping as M
from tests.conftest import rows

BASE = "https://example.org/kg/"


def test_golden_building_triples(spark):
    df = spark.createDataFrame([(1234, "building 1"), (1235, "building 2")], "id int, name string")
    s = T.iri("http://example.org/building/{id}")
    q = M.map_triples(df, [(s, "a", T.const_iri("http://example.org/Building")),
                           (s, "http://www.w3.org/2000/01/rdf-schema#label", T.literal("{name}"))])
    got = rows(q, "s", "p", "o")
    assert got == sorted([
        ("http://example.org/building/1234", T.RDF_TYPE, "http://example.org/Building"),
        ("http://example.org/building/1234", T.RDFS + "label", "building 1"),
        ("http://example.org/building/1235", T.RDF_TYPE, "http://example.org/Building"),
        ("http://example.org/building/1235", T.RDFS + "label", "building 2")])


def test_null_placeholder_gives_no_triple_and_virtual_equals_materialised(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, name string")
    tpl = [(T.iri("ex:x/{id}", {"ex": BASE}), "ex:name", T.literal("{name}")),
           (T.iri("ex:x/{id}", {"ex": BASE}), "ex:tag", T.iri("ex:tag/{name}", {"ex": BASE}))]
    mat = M.map_triples(df, tpl, prefixes={"ex": BASE})
    vir = M.map_triples(df, tpl, prefixes={"ex": BASE}, mode="virtual")
    assert rows(mat) == rows(vir)
    assert len(rows(mat)) == 2
    assert (BASE + "tag/a%20b") in [r[0] for r in rows(mat, "o")]


def test_rule_document_basic(spark):  # FIXTURES §3: 4 triples per row
    doc = {"prefixes": {"rdfs": T.RDFS, "base": BASE},
           "mappings": {"person": {"s": "base:person/$(id)", "po": [["a", "base:Person"],
                                                                      ["base:hasName", "base:person/name/$(id)~iri"]]},
                        "person-name": {"s": "base:person/name/$(id)", "po": [["a", "base:PersonName"],
                                                                                ["rdfs:label", "$(name)"]]}}}
    df = spark.createDataFrame([(51251, "Laim"), (96182, "Mia"), (219581, "Chee")], "id int, name string")
    q = M.map_rules(df, doc)
    assert q.count() == 12
    assert q.where(F.col("o_kind") == "iri").where(F.col("p") == BASE + "hasName").count() == 3


def test_rule_document_conditions_and_functions(spark):  # T12
    present = {"function": "grel:boolean_not", "parameters": [["grel:bool_b", {"function": "idlab-fn:isNull", "parameters": [["idlab-fn:str", "$(town)"]]}]]}
    tidy = {"function": "grel:string_replace", "parameters": [
        ["grel:p_string_find", "/\\s+/"], ["grel:p_string_replace", ""],
        ["grel:valueParameter", {"function": "grel:string_trim", "parameters": [["grel:valueParameter", "$(town)"]]}]]}
    doc = {"prefixes": {"kg": BASE, "grel": M.GREL, "idlab-fn": M.IDLAB},
           "mappings": {"stop": {"s": "kg:stop/$(id)", "po": [["a", "kg:Stop"], {"p": "kg:town", "o": tidy, "condition": present},
                                                            ["kg:line", "$(id)", "xsd:integer"], ["kg:note", "open daily", "en~lang"],
                                                            ["kg:state", "active"]]}}}
    df = spark.createDataFrame([(1, " Bad  Ems"), (2, "Ulm "), (3, None)], "id int, town string")
    q = M.map_rules(df, doc)
    assert sorted(r["o"] for r in q.where(F.col("p") == BASE + "town").collect()) == ["BadEms", "Ulm"]
    one = {r["p"]: r for r in q.where(F.col("s") == BASE + "stop/3").collect()}
    assert set(one) == {T.RDF_TYPE, BASE + "line", BASE + "note", BASE + "state"}
    assert (one[BASE + "line"].o, one[BASE + "line"].o_dtype) == ("3", T.XSD + "integer")
    assert (one[BASE + "note"].o, one[BASE + "note"].o_lang) == ("open daily", "en")
    assert (one[BASE + "state"].o, one[BASE + "state"].o_kind) == ("active", "literal")


def test_merge_mappings_last_wins(spark):
    v = spark.createDataFrame([("m1", 1, "old"), ("m1", 2, "new"), ("m2", 1, "only")], "mapping_id string, seq int, d string")
    assert rows(M.merge_mappings(v)) == [("m1", 2, "new"), ("m2", 1, "only")]


def test_canonicalise(spark):
    q = spark.createDataFrame([(None, "a", "p", "b", "iri", None, None), (None, "b", "p", "b", "literal", None, None)],
                              M.QUAD_SCHEMA)
    c = spark.createDataFrame([("a", "A"), ("b", "B")], "iri string, canonical string")
    assert rows(M.canonicalise(q, c), "s", "o") == [("A", "B"), ("B", "b")]


def test_virtual_mapping_prunes_branches_and_columns(spark):
    from geoweave.operators import graph as G
    from geoweave.plans.kg import PFX, tpch_quads
    from tests.conftest import SF_SMALL

    quads = tpch_quads(spark, SF_SMALL, ("nation", "customer", "orders"))
    b = G.bgp(quads, [("?c", "ex:inNation", "?n")], PFX)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "c_nationkey" in plan and "c_name" not in plan and "c_acctbal" not in plan
    assert "orders.parquet" not in plan and "o_orderkey" not in plan  # the orders branch is gone entirely
    assert b.count() == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
