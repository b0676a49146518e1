"""Updates of a stored quad table: same rows as on a DataFrame, and only the changed predicates are rewritten."""

from pathlib import Path

from geoweave.operators import graph as G
from geoweave.operators.mapping import QUAD_SCHEMA
from geoweave.sources import rdf

P = "http://x/"


def _table(spark, tmp_path, rows):
    path = str(tmp_path / "quads")
    rdf.write_quad_table(spark.createDataFrame(rows, QUAD_SCHEMA), path)
    return path


def _iri(s, p, o, g=None):
    return (g, P + s, P + p, P + o, "iri", None, None)


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def _rows(df):
    return {tuple(r) for r in df.collect()}


ROWS = [_iri("a", "knows", "b"), _iri("b", "knows", "c"), _iri("a", "likes", "b"), _iri("a", "old", "c"),
        _iri("a", "knows", "b", P + "g1"), ("x", P + "a", P + "name", "A", "literal", None, "en")]


def test_untouched_predicates_keep_their_files(spark, tmp_path):
    path = _table(spark, tmp_path, ROWS)
    before = _files(path)
    args = [("?x", f"<{P}old>", "?y")], [("?x", f"<{P}new>", "?y")], [("?x", f"<{P}old>", "?y")]
    want = _rows(G.modify(spark.createDataFrame(ROWS, QUAD_SCHEMA), *args))
    assert rdf.update_quad_table(spark, path, *args) == [P + "new", P + "old"]
    after = _files(path)
    same = {f for f in before if "old" not in f}
    assert {f: after.get(f) for f in same} == {f: before[f] for f in same}
    got = rdf.read_quad_table(spark, path)
    assert _rows(got) == want and got.count() == len(want)  # the emptied predicate is gone, nothing is doubled
    assert got.where(f"p = '{P}old'").isEmpty()


def test_update_that_matches_nothing_writes_nothing(spark, tmp_path):
    path = _table(spark, tmp_path, ROWS)
    before = _files(path)
    assert rdf.update_quad_table(spark, path, [("?x", f"<{P}none>", "?y")], [], [("?x", f"<{P}none>", "?y")]) == []
    assert _files(path) == before


def test_deleted_and_inserted_stays_and_nulls_compare(spark):
    q = spark.createDataFrame(ROWS[:2] + ROWS[:1], QUAD_SCHEMA)
    same = [("?x", f"<{P}knows>", "?y")]
    assert _rows(G.modify(q, same, same, same)) == set(ROWS[:2])
    assert _rows(G.modify(q, same, [], same)) == set()
    assert _rows(G.modify(q, [], [], same)) == set(ROWS[:2])


def test_copy_graphs_and_remove_nodes(spark, tmp_path):
    path = _table(spark, tmp_path, ROWS)
    assert rdf.copy_graphs_stored(spark, path, [P + "g1"], P + "g2") == [P + "knows"]
    assert _rows(rdf.read_quad_table(spark, path)) == set(ROWS) | {_iri("a", "knows", "b", P + "g2")}
    nodes = spark.createDataFrame([(P + "b",), (P + "b",)], "n string")
    assert rdf.remove_nodes_stored(spark, path, nodes) == [P + "knows", P + "likes"]
    assert _rows(rdf.read_quad_table(spark, path)) == {ROWS[3], ROWS[5]}


def test_rules_in_order_on_an_empty_table(spark, tmp_path):
    path = _table(spark, tmp_path, [])
    rule = {"where": [("?x", f"<{P}knows>", "?y")], "insert": [("?y", f"<{P}knownBy>", "?x")]}
    assert rdf.run_rules_stored(spark, path, [rule, rule]) == [[], []]
    assert rdf.read_quad_table(spark, path).isEmpty()
