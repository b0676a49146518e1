"""Search, URL filters and chat formatting against brute force and hand-made cases."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from geoweave.llm import chat, topk, urls

SF = "/root/testdata/sf0.01"


def test_top_inner_products(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 260)]
    rows += [(300, rows[4][1]), (400, rows[4][1]), (400, rows[5][1]), (200, rows[199][1]), (501, rows[4][1]), (502, rows[4][1]), (600, [0.0] * 6),
             (700, None), (701, [1.0, None]), (702, [math.nan] * 6), (703, [math.inf] * 6), (None, [9.0] * 6), (704, [5.0, 5.0]), (800, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, qb int").repartition(4)
    ok = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for i, q in (r for r in ok if r[0] % 100 == 0):
        want += [(i, j, sum(a * b for a, b in zip(q, c, strict=False))) for j, c in ok if j != i]
    best = []
    for i in {w[0] for w in want}:
        of = sorted((w for w in want if w[0] == i), key=lambda w: (-w[2], w[1]))[:10]
        best += [(i, k + 1, j, s) for k, (_, j, s) in enumerate(of)]
    got = [tuple(r) for r in topk.top_inner_products(df).collect()]
    assert sorted(got) == sorted(best)
    assert topk.top_inner_products(df.where("false")).count() == 0


def test_threshold_algorithm_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-1000, 1000, (4000, 3)).astype(np.int64)
    lists = topk.SortedLists(np.arange(4000), vectors)
    for q in vectors[:40]:
        score = vectors @ q
        order = np.lexsort((np.arange(4000), -score))
        want = [(int(score[i]), int(i)) for i in order if i != 7][:10]
        assert lists.top(q, 7, 10) == want


def test_url_rules(spark):
    cases = [("http://a.Example.ORG/en/12?x#y", "a.example.org", "/en/12", "example.org/en/1", "block"),
             ("https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
             ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
             ("https://example.org", "example.org", "", None, "allow"), ("x://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"),
             ("x://b.com/de/?q", "b.com", "/de/", "com/de/", "block"), ("x://b.com/DE/", "b.com", "/DE/", None, "allow"),
             (None, "", "", None, "allow"), ("no scheme.org/", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
             ("s://h.net#f/x", "h.net", "", None, "allow"), ("://org/", "org", "/", "org/", "allow"), ("s://É.com/p\nq", "É.com", "/p\nq", None, "allow")]
    pages = spark.createDataFrame([(k, c[0], "x", "y") for k, c in enumerate(cases)] + [(None, "s://h.net/", "x", "y")],
                                  "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: tuple(r)[1:] for r in urls.url_verdicts(pages, labels).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases] and got[None] == ("h.net", "/", None, "allow")
    assert urls.url_verdicts(pages.where("false"), labels).count() == 0


def test_host_reputation_shrinks(spark):
    rows = [(k, "bad.x.net") for k in range(60)] + [(100 + k, "good.x.net") for k in range(60)] + [(200, "few.x.net"), (201, "none.y.net"), (202, "")]
    marks = [(k, 0, 0) for k in range(60)] + [(100 + k, 1, 0) for k in range(60)] + [(200, 0, 1), (200, 1, 0), (None, 0, 1), (5000, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, host string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.host: r for r in urls.reputation(pages, labels).collect()}
    assert got["bad.x.net"].n == 60 and got["bad.x.net"].bound > urls.LIMIT > got["good.x.net"].bound
    assert got["good.x.net"].rate < got["none.y.net"].rate < got["few.x.net"].rate < got["bad.x.net"].rate
    assert got["few.x.net"].bound < got["bad.x.net"].bound and got[""].n == 0
    spoilt = pages.withColumn("url", F.concat(F.lit("http://"), "host", F.lit("/p")))
    verdicts = {r.host: r.verdict for r in urls.url_verdicts(spoilt, labels).collect()}
    assert verdicts["bad.x.net"] == "block" and verdicts["good.x.net"] == "allow"


def test_tool_calls(spark):
    schemas = {"add": {"a": ("integer", True), "b": ("number", False)}, "none": {}}
    calls = spark.createDataFrame(
        [(1, 0, 0, "p", "add", '{"b": 2.5, "a": 1}', "x"), (1, 0, 1, "q", "add", '{"a": "1"}', "x"), (1, 2, 0, "p", "add", '{"a": 3}', "x"),
         (1, 9, 0, "late", "none", "{}", "x"), (2, 0, 0, "p", "other", "{}", "x"), (2, 1, 0, "r", "add", "[1]", "x"), (2, 2, 0, "s", "add", "{oops", "x"),
         (2, 3, 0, "t", "none", '{"z": {"y": 1, "b": [2, {"d": 1, "c": 2}]}}', "x"), (2, 4, 0, "u", "add", None, "x"), (None, 0, 0, "p", "none", "{}", "x"),
         (3, 0, 0, None, "none", "{}", "x"), (4, 0, 0, "w", "none", "{}", "x"), (4, 0, 0, "w", "none", "{}", "x")],
        "conv_id long, turn long, seq int, call_id string, tool string, arguments string, status string")
    results = spark.createDataFrame(
        [(1, 1, 0, "p", "3.5"), (1, 3, 0, "p", "again"), (1, 4, 0, "late", "early\n\"q\""), (1, 5, 0, "zz", None), (None, 1, 0, "p", "x"), (4, 1, 0, "w", "é")],
        "conv_id long, turn long, seq int, call_id string, content string")
    others = spark.createDataFrame([(1, 0, 0, "system", None), (None, 0, 0, None, "hi")], "conv_id long, turn long, seq int, role string, content string")
    rows = chat.link_calls(calls, results, schemas, others).collect()
    by = {(r.conv_id, r.turn, r.seq, r.kind): r for r in rows}
    assert len(rows) == 13 + 6 + 2
    assert by[1, 0, 0, "call"].json == '{"arguments":{"a":1,"b":2.5},"call_id":"p","kind":"call","status":"linked","tool":"add","valid":true}'
    assert by[1, 0, 1, "call"].status == "pending" and by[1, 0, 1, "call"].problems == ["mistyped a"]
    assert by[1, 2, 0, "call"].status == "repeated" and by[1, 3, 0, "result"].status == "repeated"
    early = by[1, 4, 0, "result"]
    assert (early.status, early.anchor, early.level) == ("linked", 9, 1) and json.loads(early.json)["content"] == 'early\n"q"'
    assert by[1, 5, 0, "result"].status == "orphan" and by[1, 5, 0, "result"].json == '{"call_id":"zz","kind":"result","status":"orphan"}'
    assert by[2, 0, 0, "call"].problems == ["unknown tool"]
    assert [by[2, k, 0, "call"].problems for k in (1, 2, 4)] == [["not an object"]] * 3
    assert by[2, 3, 0, "call"].problems == ["unknown z"] and '{"z":{"b":[2,{"c":2,"d":1}],"y":1}}' in by[2, 3, 0, "call"].json
    assert by[None, 0, 0, "call"].status == "pending" and by[None, 1, 0, "result"].status == "orphan" and by[3, 0, 0, "call"].status == "pending"
    assert [r.status for r in rows if r.conv_id == 4] == ["linked"] * 3
    assert by[1, 0, 0, "message"].json == '{"kind":"message","role":"system"}'
    order = sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.anchor, r.level, r.turn, r.seq))
    place = {(r.kind, r.call_id): k for k, r in enumerate(order) if r.status == "linked"}
    assert all(place["call", c] < place["result", c] for c in ("p", "late"))
    assert chat.link_calls(calls.where("false"), results.where("false"), schemas).count() == 0


def test_plain_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", None, 5), (1, 1, "assistant", "b", 5), (None, 0, "user", "a", 5), (1, None, "assistant", "c", 5), (1, 3, None, "d", 5)],
                                 "conv_id long, turn long, role string, text string, seq int")
    calls, results, others = chat.conversation_events(rows)
    got = chat.link_calls(calls, results, chat.REPLY, others).collect()
    assert len(got) == 5 and {r.status for r in got if r.conv_id == 1 and r.turn in (0, 1)} == {"linked"}
    assert next(r for r in got if r.kind == "call" and r.conv_id == 1).problems == ["missing text", "missing words"]
