"""The corpus pipeline, stage by stage against brute force on a small table."""

import random

import corpus_pipeline as P
from geoweave.llm.common import stored
from tests.conftest import SF_SMALL
from tests.llm import brute


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    some = {r.doc_id: r for r in docs.collect()}
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first().text
    noise = lambda n: " ".join(f"n{rng.randrange(10**7)}" for _ in range(n))
    passage = noise(60)
    extra = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, noise(30), "en", "s", 1),
             (9003, some[3].text, "en", "s", 1), (9003, some[3].text, "en", "s", 1),
             (9004, noise(20) + " " + passage + " " + noise(20), "en", "s", 1), (9005, noise(9) + " " + passage, "en", "s", 1),
             (9006, noise(20) + " " + item + " " + noise(20), "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "benchmark", "packing"]

    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    kept = stored(P.STAGES[0][1](spark, docs, str(tmp_path)), "t")
    assert kept.columns == columns and set(rows(kept)) <= set(rows(docs)) and kept.where("doc_id >= 9000 or doc_id is null").count() == len(extra)

    before = rows(kept)
    single = stored(P.STAGES[1][1](spark, kept, str(tmp_path)), "d")
    comp, sets = brute.components([r[1] for r in before], 80)
    groups = {c for c, s in zip(comp, sets, strict=True) if s}
    assert single.columns == columns and single.count() == len(groups) + sum(not s for s in sets)
    assert set(rows(single)) <= set(before)

    before = rows(single)
    clean = stored(P.STAGES[2][1](spark, single, str(tmp_path)), "r")
    left = brute.removed([r[1] for r in before])
    want = [(r[0], None if r[1] is None else w[4].decode("utf-8", "ignore"), r[2], r[3]) for r, w in zip(before, left, strict=True)]
    assert clean.columns == columns and sorted((r[:4] for r in rows(clean)), key=str) == sorted(want, key=str)
    assert passage not in " ".join(r[1] or "" for r in rows(clean))

    before = rows(clean)
    free = stored(P.STAGES[3][1](spark, clean, str(tmp_path)), "b")
    items = [brute.tokens(r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    grams = [{tuple(i[k:k + 5]) for k in range(len(i) - 4)} for i in items]

    def leaked(text):
        t = brute.tokens(text)
        own = {tuple(t[k:k + 5]) for k in range(len(t) - 4)}
        return any(len(i) >= 5 and own & g and brute.tiling(t, i, 5)[0] >= 0.5 * len(i) for i, g in zip(items, grams, strict=True))

    assert free.columns == columns and rows(free) == [r for r in before if not leaked(r[1])] and free.where("doc_id = 9006").count() == 0

    packed = P.STAGES[4][1](spark, free, str(tmp_path))
    assert packed.select("doc_id", "piece").distinct().count() >= free.select("doc_id").distinct().count()
    final = P.run(spark, str(tmp_path))
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(final.select(*keys)) == rows(packed.select(*keys))


def test_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
