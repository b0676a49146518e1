"""K3: mapping tables compiled to one scan per source."""

import re

import pytest

from geoweave.operators import mapping as M
from geoweave.plans import mappings
from geoweave.plans.tables import read
from tests.conftest import SF_SMALL, rows

EX = {"ex": "http://e/"}


def _table(spark, *defs):
    return spark.createDataFrame(list(defs), M.DEFINITION_SCHEMA)


def test_over_a_hundred_mappings_one_scan_a_source_and_pruned_columns(spark):
    assert len({d[0] for d in mappings.definitions()}) > 100
    plan = mappings.map_compiled(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(mappings.COLUMNS)
    read_columns = " ".join(re.findall(r"ReadSchema: struct<[^>]*>", plan))
    assert "html" not in read_columns and "text" not in read_columns and "o_totalprice" not in read_columns


def test_sql_sources_last_definition_sets_and_nulls(spark):
    people = spark.createDataFrame([(1, "Ann", None), (1, "Ann", None), (2, None, 5)], "id int, name string, age int")
    people.createOrReplaceTempView("compiled_people")
    source = "SELECT id, name, age FROM compiled_people"
    t = _table(spark, ("m1", 1, source, "ex:p/{id}", "ex:old", "{name}", "literal", None, None, None),
               ("m1", 2, source, "ex:p/{id}", "ex:name", "{name}", "literal", None, "en", None),
               ("m2", 1, source, "_:b{id}", "ex:age", "{age}", "literal", "xsd:int", None, "age > 4"),
               ("m3", 1, "known", "ex:p/{id}", "a", "ex:Person", "constant", None, None, "id = 2"))
    got = rows(M.compile_mappings(t, {"known": people}, prefixes=EX), "s", "p", "o", "o_lang")
    assert got == sorted([("http://e/p/1", "http://e/name", "Ann", "en"), ("_:b2", "http://e/age", "5", None),
                          ("http://e/p/2", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/Person", None)],
                         key=lambda r: tuple((x is None, str(x)) for x in r))
    bag = M.compile_mappings(t, {"known": people}, distinct=False, prefixes=EX)
    assert bag.count() == 4


def test_no_definitions_and_incomplete_ones(spark):
    assert M.compile_mappings(_table(spark).limit(0), {}).columns == M.QUAD_COLUMNS
    broken = _table(spark, ("m", 1, "region", None, "ex:x", "{r_name}", "literal", None, None, None))
    with pytest.raises(ValueError, match="incomplete mapping m"):
        M.compile_mappings(broken, {"region": read(spark, SF_SMALL, "region")})
