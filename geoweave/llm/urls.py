"""URL filtering by rules and by empirical-Bayes host reputation (DataFrame functions only).

Labelled pages count as good or bad outcomes of their host.  Bad rates are shrunk through beta-binomial priors: the corpus rate is
the prior of a suffix, the suffix of a registered domain, the domain of a host.  Each level's prior strength comes from the
data by the method of moments; a host is blocked if the lower posterior bound of its bad rate exceeds a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.session import cut_lineage

#: Fixed rules: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/"))
#: A host is blocked if the bound, this many standard deviations below the mean, exceeds this bad rate.
LIMIT, DEVIATIONS = 0.25, 1.645
#: Bounds of the correlation of outcomes inside a group, from which a prior's strength follows.
LEAST, MOST = 0.001, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def ruling(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Longest fitting rule (``host`` + ``path``) and its verdict, null if none fits; ties go to the earlier text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def shrunk(groups: DataFrame, prior: str, name: str) -> DataFrame:
    """``groups`` (``n, k`` and the prior rate) with the posterior rate ``name`` and the prior strength ``s``."""
    p, n, k = F.col(prior), F.col("n"), F.col("k")
    x = groups.agg(F.sum((k - n * p) * (k - n * p) - n * p * (1 - p)).alias("over"),
                   F.sum(n * (n - 1) * p * (1 - p)).alias("pairs")).first()
    rho = min(MOST, max(LEAST, x.over / x.pairs)) if x.pairs else LEAST
    s = F.lit(1 / rho - 1)
    return groups.withColumn("s", s).withColumn(name, (k + s * p) / (n + s))


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, n, k, rate, bound``: labelled and bad pages of each host, shrunk bad rate and its lower posterior bound.

    ``pages``: ``page_id, host``.  A page is bad if a label row with its id has quality 0 or toxic 1.  The bound is the posterior mean
    less DEVIATIONS standard deviations of the beta posterior.  Without any label every rate is 0.
    """
    marks = (labels.select(F.col("doc_id").cast("long").alias("page_id"),
                           F.coalesce(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"), F.lit(0)).alias("bad"))
             .where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad")))
    hosts = cut_lineage(pages.join(marks, "page_id", "left").groupBy("host")
                        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
                        .withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    p0 = (total.k + 0.5) / (total.n + 1) if total.n else 0.0
    add = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = cut_lineage(shrunk(hosts.groupBy("suffix").agg(*add).withColumn("p", F.lit(p0)), "p", "rate1"))
    domains = hosts.groupBy("domain", "suffix").agg(*add).join(suffixes.select("suffix", "rate1"), "suffix")
    domains = cut_lineage(shrunk(domains, "rate1", "rate2"))
    last = cut_lineage(hosts.join(domains.select("domain", "suffix", "rate2"), ["domain", "suffix"]))
    last = shrunk(last, "rate2", "rate")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("s") + 1))
    return last.select("host", "n", "k", "rate", (F.col("rate") - DEVIATIONS * sd).alias("bound"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, limit: float = LIMIT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages``: the longest rule's verdict, else the host reputation's.

    A null url, or one without ``://``, has empty host and path and is judged with all others of that kind; repeated rows are pages each; a
    null page_id has no label; an empty table gives no rows.
    """
    host, path = host_and_path()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = cut_lineage(reputation(rows.select("page_id", "host"), labels).select("host", (F.col("bound") > limit).alias("bad")))
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    return rows.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
