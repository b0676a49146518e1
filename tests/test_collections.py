"""GeoJSON collections read in parts."""

import json

import pytest

from geoweave.sources import features


@pytest.fixture
def small_splits(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "2000")
    spark.conf.set(keys[1], "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


NOTES = ['plain', 'brace { and }', 'quote " and \\" {', 'back\\slash\\', '}{"type":"Feature"}', '', 'ünïcode 中文 {{', None, '\n line {"']


def _feature(i):
    shape = [{"type": "Point", "coordinates": [i, 1]}, None,
             {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0, 0]}, {"type": "LineString", "coordinates": [[0, 0], [1, i]]}]},
             {"type": "GeometryCollection", "geometries": []}][i % 4]
    return {"geometry": shape, "properties": {"id": i, "note": NOTES[i % len(NOTES)]}, "type": "Feature"}


@pytest.mark.parametrize("indent", [None, 2])
def test_split_equals_whole(spark, small_splits, tmp_path, indent):
    for name, n in (("a", 300), ("b", 1), ("c", 0)):
        doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}},
               "features": [_feature(i) for i in range(n)], "bbox": [0, 0, 1, 1], "foot": {"a": {"b": "}"}}}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("")
    df = features.read_collections(spark, str(tmp_path), "id long, note string")
    assert spark.read.option("lineSep", "{").text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted(((r.id, r.note, None if r.members is None else [m.type for m in r.members]) for r in df.collect()), key=lambda t: t[0])
    want = []
    for f in [_feature(i) for i in range(300)] + [_feature(0)]:
        g = f["geometry"]
        kinds = None if g is None else [m["type"].upper() for m in g.get("geometries", [g])]
        want.append((f["properties"]["id"], f["properties"]["note"], kinds))
    assert got == sorted(want, key=lambda t: t[0])
