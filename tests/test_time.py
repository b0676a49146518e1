"""Layers at an instant, and a stream that forgets known ids behind its watermark."""

import datetime as dt
import os

from geoweave.operators import raster as RS
from geoweave.streaming.events import run_available


def test_latest_granule_at_an_instant(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    px = spark.createDataFrame([("a", 1, 0, 0, 1.0), ("a", 1, 0, 1, 2.0), ("b", 1, 0, 1, 3.0), ("b", 1, 0, 2, 4.0), ("c", 1, 0, 1, None),
                                ("d", 1, 0, 1, 9.0), ("e", 1, 0, 1, 7.0)],
                               "location string, band int, row long, col long, value double")
    gr = spark.createDataFrame([("a", at(0), "m", 1), ("b", at(6), "n", 1), ("c", at(7), "o", 1), ("d", at(6), "p", 0),
                                ("e", at(12), "q", 1), ("nothing", at(1), "r", 1)], "location string, time timestamp_ntz, label string, priority int")
    index = RS.granule_index(px, gr)
    bounds = {r.location: (r.row_min, r.row_max, r.col_min, r.col_max) for r in index.collect()}
    assert bounds["a"] == (0, 0, 0, 1) and bounds["nothing"] == (None,) * 4
    pick = lambda **k: {(r.col, r.value, r.label) for r in RS.mosaic_at(px, index, **k).collect()}
    assert pick(at=at(8)) == {(0, 1.0, "m"), (1, 3.0, "n"), (2, 4.0, "n")}  # equal times: priority; NULL covers nothing
    assert pick(at=at(3)) == {(0, 1.0, "m"), (1, 2.0, "m")}
    assert pick() == {(0, 1.0, "m"), (1, 7.0, "q"), (2, 4.0, "n")}
    assert pick(window=(0, 5, 2, 9)) == {(2, 4.0, "n")}
    assert pick(at=at(8), since=at(5)) == {(1, 3.0, "n"), (2, 4.0, "n")}
    assert pick(at=dt.datetime(2023, 1, 1)) == set()


def test_state_shrinks_behind_the_watermark(spark, tmp_path):
    src, schema = tmp_path / "in", "k long, ts timestamp"
    def batch(name, rows):
        spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for k, h in rows], schema).coalesce(1).write.parquet(str(src / name))
    for i, rows in enumerate([[(k, 0) for k in range(20)], [(k, 0) for k in range(5)] + [(50, 1)], [(60, 48)], [(61, 49), (3, 0)], [(60, 49), (62, 49)]]):
        batch(f"b{i}", rows)
    flat = tmp_path / "flat"  # one file a batch, in order of time
    flat.mkdir()
    for i in range(5):
        part = next((src / f"b{i}").glob("*.parquet"))
        (flat / f"{i}.parquet").write_bytes(part.read_bytes())
        os.utime(flat / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    states = []
    out = run_available(spark, str(flat), schema, lambda s: s, "t", dedupe_key="k", within=("ts", "2 hours"), files_per_batch=1, progress=states)
    got = sorted(r.k for r in out.collect())
    assert got == [*range(20), 50, 60, 61, 62]  # replays skipped, the late row dropped
    # the batch that moves the watermark still holds the old keys, the next one drops them
    assert states == [20, 21, 22, 2, 3]
