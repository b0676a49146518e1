"""Registered queries of the ten operators, each over its whole table, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoweave.llm.alignment import align_tokens
from geoweave.llm.chat import REPLY, conversation_events, link_calls
from geoweave.llm.decontaminate import contaminated
from geoweave.llm.extraction import main_texts
from geoweave.llm.minhash import near_duplicates
from geoweave.llm.packing import pack
from geoweave.llm.phrases import collocations
from geoweave.llm.quality import quality
from geoweave.llm.suffixes import repeat_digest
from geoweave.llm.tokencounts import section_tokens
from geoweave.llm.topk import top_inner_products
from geoweave.llm.toxicity import toxicity
from geoweave.llm.urls import url_verdicts
from geoweave.plans.tables import read

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


@query("op1_benchmark_decontamination")
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))


@query("op3_exact_top_k", """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op4_minhash_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5
      THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN comp c ON c.node = s.doc_id
""")
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_suffix_array_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d)),
rep AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, i FROM w JOIN rep USING (m)),
b AS (SELECT r, j, substr(x, 2 * j + 1, 2) AS h FROM (SELECT r, x, unnest(range(0, len(x) // 2)) AS j FROM d)),
c AS (SELECT b.r, b.j, b.h, max(hit.i) OVER (PARTITION BY b.r ORDER BY b.j) AS last
      FROM b LEFT JOIN hit ON hit.r = b.r AND hit.i = b.j),
g AS (SELECT r, j, h, coalesce(j - last < 200, false) AS gone FROM c),
k AS (SELECT r, j, h, gone, lag(gone, 1, false) OVER (PARTITION BY r ORDER BY j) AS before FROM g),
s AS (SELECT r, count_if(gone) AS n_removed, count_if(gone AND NOT before) AS n_spans,
        coalesce(string_agg(h, '' ORDER BY j) FILTER (NOT gone), '') AS kept FROM k GROUP BY r)
SELECT d.doc_id, len(d.x) // 2 AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(s.kept, ''))) AS kept_sha256
FROM d LEFT JOIN s ON s.r = d.r
""")
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_url_filters", r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS k, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
    string_split(host, '.')[-1] AS suffix FROM p LEFT JOIN m ON m.doc_id = p.page_id GROUP BY host),
g0 AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5) / (sum(n) + 1) ELSE 0 END AS p FROM h),
a1 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k) AS k, any_value(g0.p) AS p FROM h, g0 GROUP BY suffix),
s1 AS (SELECT 1 / coalesce(least(0.5, greatest(0.001, sum((k - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0))), 0.001) - 1 AS s FROM a1),
r1 AS (SELECT suffix, (k + s * p) / (n + s) AS p FROM a1, s1),
a2 AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k) AS k, any_value(r1.p) AS p FROM h JOIN r1 USING (suffix) GROUP BY domain, suffix),
s2 AS (SELECT 1 / coalesce(least(0.5, greatest(0.001, sum((k - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0))), 0.001) - 1 AS s FROM a2),
r2 AS (SELECT domain, suffix, (k + s * p) / (n + s) AS p FROM a2, s2),
a3 AS (SELECT host, h.n::DOUBLE AS n, h.k, r2.p FROM h JOIN r2 USING (domain, suffix)),
s3 AS (SELECT 1 / coalesce(least(0.5, greatest(0.001, sum((k - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0))), 0.001) - 1 AS s FROM a3),
r3 AS (SELECT host, n + s AS t, (k + s * p) / (n + s) AS p FROM a3, s3),
b AS (SELECT host, p - 1.645 * sqrt(p * (1 - p) / (t + 1)) > 0.25 AS bad FROM r3),
x AS (
  SELECT page_id, host, path, bad, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow' WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM x
""")
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages", "page_id", "url"), read(spark, sf_dir, "labels"))


@query("op10_chat_formatting", r"""
WITH c AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, text,
    len(list_filter(regexp_split_to_array(text, '[ \x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
cs AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.call_id = c.call_id) THEN 'linked' ELSE 'pending' END AS status FROM c),
rs AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.call_id = r.call_id) THEN 'linked' ELSE 'orphan' END AS status FROM r)
SELECT conv_id, call_id, turn, 0 AS seq, 'call' AS kind, status, [] :: VARCHAR[] AS problems, turn AS anchor, 0 AS level,
  '{"arguments":{"text":' || to_json(text) || ',"words":' || words || '},"call_id":"' || call_id || '","kind":"call","status":"' || status
  || '","tool":"reply","valid":true}' AS json FROM cs
UNION ALL
SELECT conv_id, call_id, turn, 0, 'result', status, [] :: VARCHAR[], turn, CASE WHEN status = 'linked' THEN 1 ELSE 0 END,
  '{"call_id":"' || call_id || '","content":' || to_json(text) || ',"kind":"result","status":"' || status || '"}' FROM rs
UNION ALL
SELECT conv_id, NULL, turn, 0, 'message', 'plain', [] :: VARCHAR[], turn, 0,
  '{"content":' || to_json(text) || ',"kind":"message","role":' || to_json(role) || '}'
FROM conversations WHERE role NOT IN ('user', 'assistant')
""")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = conversation_events(read(spark, sf_dir, "conversations"))
    return link_calls(calls, results, REPLY, others)


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op13_collocations", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
i AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM i GROUP BY ALL HAVING count(*) >= 100),
e AS (
  SELECT lang, unnest([array_to_string(x[1:k - 1], ' '), array_to_string(x[2:], ' ')]) AS phrase, a
  FROM (SELECT lang, k, a, string_split(phrase, ' ') AS x FROM f WHERE k > 2)),
g AS (SELECT lang, phrase, max(a) AS longer FROM e GROUP BY lang, phrase),
c AS (SELECT f.* FROM f LEFT JOIN g USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
x AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS x, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, t.n, cut,
    ((1000::HUGEINT * x.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.x[1:cut], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.x[cut + 1:], ' ') JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM b QUALIFY rank <= 2000
""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents", "lang", "text"))
