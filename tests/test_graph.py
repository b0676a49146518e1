import pytest
from pyspark.sql import functions as F

from geoweave.functions import terms as T
from geoweave.operators import closure as CL, graph as G
from geoweave.sources.rdf import parse_nquads, to_nquads
from tests.conftest import rows

EX = "http://example.org/"


def nq(spark, text):
    quads, rejects = parse_nquads(spark.createDataFrame([(ln,) for ln in text.strip().splitlines()], "value string"))
    return quads, rejects


def test_rdfs_closure_two_triples_give_nine(spark):  # BlazegraphClientTest delta
    quads, _ = nq(spark, f"""
<{EX}a> <{T.RDF_TYPE}> <{EX}A> .
<{EX}A> <{T.RDFS}subClassOf> <{EX}B> .
""")
    out = CL.rdfs_closure(quads)
    assert out.count() == 9
    assert (EX + "a", T.RDF_TYPE, EX + "B") in rows(out, "s", "p", "o")
    assert CL.rdfs_closure(out).count() == 9  # idempotent


def test_quads_per_graph_counts_and_roundtrip(spark):  # quads fixture: 4, 3, 2
    lines = [f'<{EX}s{i}> <{EX}p> "v{i}" <{EX}g1> .' for i in range(4)]
    lines += [f'<{EX}s{i}> <{EX}p> <{EX}o{i}> <{EX}g2> .' for i in range(3)]
    lines += [f'<{EX}s{i}> <{EX}p> "2024-01-0{i + 1}"^^<{T.XSD}date> .' for i in range(2)]
    lines += ['# comment', f'<{EX}x> <{EX}p> "say \\"hi\\"\\nthere"@en .', "not a triple"]
    quads, rejects = nq(spark, "\n".join(lines))
    counts = dict((r[0], r[1]) for r in quads.groupBy("g").count().collect())
    assert counts[EX + "g1"] == 4 and counts[EX + "g2"] == 3 and counts[None] == 3
    assert rejects.count() == 1
    lit = quads.where(F.col("o_lang") == "en").first()
    assert lit["o"] == 'say "hi"\nthere'
    back, _ = parse_nquads(to_nquads(quads))
    assert rows(back) == rows(quads)


def _people(spark):
    q, _ = nq(spark, f"""
<{EX}alice> <{EX}knows> <{EX}bob> .
<{EX}bob> <{EX}knows> <{EX}carol> .
<{EX}alice> <{EX}name> "Alice" .
<{EX}bob> <{EX}name> "Bob" .
<{EX}carol> <{EX}age> "30"^^<{T.XSD}int> .
""")
    return q


def test_bgp_optional_path_values(spark):
    q = _people(spark)
    b = G.bgp(q, [("?x", f"<{EX}knows>", "?y"), ("?y", f"<{EX}name>", "?n")])
    assert rows(b, "x", "n") == [(EX + "alice", "Bob")]
    opt = G.optional(G.bgp(q, [("?x", f"<{EX}knows>", "?y")]), G.bgp(q, [("?y", f"<{EX}name>", "?n")]))
    assert rows(opt, "x", "n") == [(EX + "alice", "Bob"), (EX + "bob", None)]
    p = G.path(q, "?a", [f"<{EX}knows>", f"<{EX}knows>"], "?c")
    assert rows(p, "a", "c") == [(EX + "alice", EX + "carol")]
    v = G.values(G.bgp(q, [("?x", f"<{EX}knows>", "?y")]), "?x", [f"<{EX}bob>"])
    assert rows(v, "x") == [(EX + "bob",)]
    with pytest.raises(ValueError):
        G.bgp(q, [("?x", f"<{EX}knows>", "?y"), ("?a", f"<{EX}name>", "?b")])


def test_typed_literal_patterns_do_not_mix(spark):
    q = _people(spark)
    assert G.bgp(q, [("?p", f"<{EX}age>", G.Lit("30", T.XSD + "int"))]).count() == 1
    assert G.bgp(q, [("?p", f"<{EX}age>", G.Lit("30"))]).count() == 0


def test_modify_and_rules_in_order(spark):
    q = _people(spark)
    m = G.modify(q, delete=[("?x", f"<{EX}name>", "?n")], insert=[("?x", f"<{EX}label>", "?n")],
                 where=[("?x", f"<{EX}name>", "?n")])
    assert m.where(F.col("p") == EX + "name").count() == 0
    assert m.where(F.col("p") == EX + "label").count() == 2
    rules = [{"where": [("?x", f"<{EX}knows>", "?y")], "insert": [("?y", f"<{EX}knownBy>", "?x")]},
             {"where": [("?y", f"<{EX}knownBy>", "?x")], "insert": [("?y", "a", f"<{EX}Known>")]}]
    out = G.run_rules(q, rules)
    assert out.where(F.col("o") == EX + "Known").count() == 2


def test_construct_and_shape_json(spark):
    q = _people(spark)
    c = G.construct(G.bgp(q, [("?x", f"<{EX}knows>", "?y")]), [("?y", f"<{EX}knows>", "?x")])
    assert c.count() == 2
    b = G.optional(G.bgp(q, [("?x", f"<{EX}knows>", "?y")]), G.bgp(q, [("?x", f"<{EX}name>", "?n")]))
    js = G.shape_json(b, "?x", {"name": {"var": "?n", "required": True}, "friends": {"var": "?y"}})
    assert js.count() == 2


def test_reference_closure_orders(spark):  # DatasetReaderTest fixture
    edges = spark.createDataFrame([
        ("trivialExternal", "implicitlyNamed"), ("nonTrivialExternal", "trivialExternal"),
        ("nonTrivialExternal", "explicitlyNamed"), ("trivialWithOntology", "ontology"),
        ("nonTrivialWithOntology", "nonTrivialExternal"), ("nonTrivialWithOntology", "ontology")], "name string, ref string")
    names = spark.createDataFrame([(n,) for n in ["trivialExternal", "implicitlyNamed", "nonTrivialExternal",
                                                    "explicitlyNamed", "trivialWithOntology", "ontology",
                                                    "nonTrivialWithOntology"]], "name string")
    got = dict(rows(CL.reference_closure(edges, names, "nonTrivialWithOntology")))
    assert got == {"nonTrivialWithOntology": 0, "nonTrivialExternal": 1, "ontology": 1, "trivialExternal": 2,
                   "explicitlyNamed": 2, "implicitlyNamed": 3}
    assert len(rows(CL.reference_closure(edges, names, "unknown"))) == 7
    bad = edges.unionByName(spark.createDataFrame([("ontology", "missing")], "name string, ref string"))
    with pytest.raises(ValueError):
        CL.reference_closure(bad, names, None)
    cyc = edges.unionByName(spark.createDataFrame([("implicitlyNamed", "nonTrivialWithOntology")], "name string, ref string"))
    with pytest.raises(ValueError):
        CL.reference_closure(cyc, names, "nonTrivialWithOntology")


def test_quad_table_partition_pruning(spark, tmp_path):
    from geoweave.sources.rdf import read_quad_table, write_quad_table

    q = _people(spark)
    write_quad_table(q, str(tmp_path / "quads"))
    stored = read_quad_table(spark, str(tmp_path / "quads"))
    b = G.bgp(stored, [("?x", f"<{EX}knows>", "?y")])
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "knows" in plan
    assert rows(b, "x", "y") == [(EX + "alice", EX + "bob"), (EX + "bob", EX + "carol")]


def test_optional_after_an_unbound_optional(spark):
    """Solutions that leave a variable unbound take the second OPTIONAL's value; bound ones must agree."""
    left = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), ("d", None)], "c string, v string")
    right = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "7", "p"), ("b", "8", "q"), ("c", "4", "z")], "c string, v string, w string")
    got = {tuple(r) for r in G.optional(left, right, maybe=["?v"]).collect()}
    assert got == {("a", "1", "x"), ("b", "7", "p"), ("b", "8", "q"), ("c", "3", None), ("d", None, None)}
