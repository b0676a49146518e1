"""Near-duplicate groups by MinHash with tensored banding, verified on full shingle sets.

Documents with equal shingle sets collapse to one class first.  Two small collections of
``bands`` minhash keys each (``width`` minhashes a key) are combined pairwise into ``bands ** 2`` table keys: 
two classes are candidates if a key of the first and a key of the second collection agree, for
``2 * bands * width`` minhashes instead of ``2 * bands ** 2 * width``.

Links are confirmed on full sets without listing all pairs of a bucket: each member is compared with its
bucket's smallest class, what is linked is contracted, and only classes of one bucket that are still in different
components are compared - pair by pair in small buckets, in blocks inside tasks for large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import (U64, mix, slices, small_batches, stored, text_buffer, text_hash, word_table, words)
from geoweave.session import cut_lineage

#: Fixed by the word rule: space and the control characters tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
SHINGLE = 5
#: Keys in each collection and minhashes in each key: at similarity 0.85 a pair is missed once in about 14,000.
BANDS, WIDTH = 8, 2
THRESHOLD = 85
#: Members of a bucket up to which differing components are compared pair by pair; larger ones go in blocks.
SMALL_BUCKET = 16
#: Classes in one block of a large bucket.
BLOCK = 256


def shingle_sets(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row: windows of five words, or all words if there are fewer."""
    h, row, _, _ = words(buf, start, end, word_table(SEPARATORS))
    n = len(start)
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    out = [np.zeros(0, U64)] * n
    if not len(h):
        return out
    factors = mix(np.arange(1, SHINGLE + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
    long = np.zeros(len(h), U64)
    for k in range(SHINGLE):
        long[: len(h) - k] += h[k:] * factors[k]
    long = mix(long)
    for i in range(n):
        if count[i] >= SHINGLE:
            out[i] = np.unique(long[first[i]: first[i + 1] - SHINGLE + 1])
        elif count[i]:
            part = h[first[i]: first[i + 1]] * factors[: count[i]]
            out[i] = mix(np.array([part.sum(dtype=U64) + U64(count[i])], U64))
    return out


def signatures(sets: list[np.ndarray], bands: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit set identities (n, 2) and both collections' keys (n, bands) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    ident = np.array([mix(np.add.reduceat(mix(flat ^ U64(0xA5A5)), at)), mix(np.add.reduceat(mix(flat + U64(77)), at))]).T
    seeds = mix(np.arange(1, 2 * bands * width + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    mins = np.array([np.minimum.reduceat(flat * s, at) for s in seeds]).T
    keys = np.zeros((len(sets), 2 * bands), U64)
    for k in range(2 * bands):
        keys[:, k] = k + 1
        for j in range(width):
            keys[:, k] = mix(keys[:, k] * U64(31) + mins[:, k * width + j])
    return ident, keys[:, :bands], keys[:, bands:]


def sketch(documents: DataFrame, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """``doc_id, th, n_shingles, cls, a, b`` per row; ``cls`` (16 bytes) names the shingle set, null if empty."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, start, end = text_buffer(batch.column(1))
            for i, j in slices(start, end):
                sets = shingle_sets(buf, start[i:j], end[i:j])
                full = [k for k, s in enumerate(sets) if len(s)]
                cls: list = [None] * (j - i)
                a: list = [[]] * (j - i)
                b: list = [[]] * (j - i)
                if full:
                    ident, x, y = signatures([sets[k] for k in full], bands, width)
                    raw, x, y = ident.tobytes(), x.view(np.int64), y.view(np.int64)
                    for q, k in enumerate(full):
                        cls[k], a[k], b[k] = raw[16 * q: 16 * q + 16], x[q], y[q]
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], n, pa.array(cls, pa.binary()),
                     pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64()))],
                    ["doc_id", "th", "n_shingles", "cls", "a", "b"])

    return documents.select(F.col("doc_id").cast("long"), "text", text_hash().alias("th")).mapInArrow(
        run, "doc_id long, th long, n_shingles long, cls binary, a array<long>, b array<long>")


def table_keys(classes: DataFrame) -> DataFrame:
    """``key, cls, n``: members of every table key that at least two classes share.

    Keys of one collection that no other class has are dropped before the pairs are formed.
    """
    def shared(side: str) -> DataFrame:
        long = classes.select("cls", F.posexplode(side).alias("at", "k"))
        often = cut_lineage(long.groupBy("at", "k").count().where("count > 1").select("at", "k"))
        return long.join(often, ["at", "k"], "left_semi").select("cls", F.xxhash64("at", "k").alias(side))

    pairs = shared("a").join(shared("b"), "cls").select("cls", F.xxhash64("a", "b").alias("key"))
    pairs = stored(pairs.join(classes.select("cls", "n"), "cls"), "keys")
    often = cut_lineage(pairs.groupBy("key").agg(F.count("*").alias("m"), F.min("cls").alias("top"), F.min("n").alias("least"))
                        .where("m > 1"))
    return pairs.join(often, "key")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``x, y`` whose full sets have ``100 * intersection >= threshold * union``."""
    common = F.size(F.array_intersect("sx", "sy"))
    return (pairs.join(sets.select(F.col("cls").alias("x"), F.col("set").alias("sx")), "x")
            .join(sets.select(F.col("cls").alias("y"), F.col("set").alias("sy")), "y")
            .where(F.lit(100) * common >= F.lit(threshold) * (F.size("sx") + F.size("sy") - common))
            .select("x", "y"))


def comparable(threshold: int) -> F.Column:
    """Sizes that allow the threshold at all."""
    return ((F.lit(100) * F.least("nx", "ny")) >= (F.lit(threshold) * F.greatest("nx", "ny")))


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` (smallest node reachable) for every node of ``links(x, y)``.

    Large-star and small-star rounds: each node hooks its larger neighbours to the smallest one seen.  Every round
    is a partial aggregation and a join, so a hub's edges spread over tasks; rounds grow with the logarithm of the size.
    """
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    edges = cut_lineage(links.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    mark = None
    while True:
        both = edges.select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(low, "u").select(F.inline(F.array(pair("v", "m"), pair("u", "m")))).where("u != v").distinct())
        edges = cut_lineage(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not now.n or (now.n, now.s) == mark:
            break
        mark = (now.n, now.s)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def similar_in_blocks(members: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Links between classes of one large bucket that lie in different components.

    ``members``: ``key, cls, comp, set`` and the bucket's size ``m``.  A bucket of m members is cut into ``m / block`` blocks by hash;
    each pair of blocks is one group of bounded size, compared by counting common shingles.  Of the links of a
    group only a spanning forest leaves the task.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / block)).cast("int")
    dealt = (members.withColumn("blocks", parts)
             .withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                     "mine", "cls", "comp", "set"))

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s, np.int64) for s in part["set"]]
        n, size = len(sets), np.array([len(s) for s in sets])
        comp, which = pd.factorize(part["comp"])[0], part["mine"].to_numpy()
        flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
        _, col, often = np.unique(flat, return_inverse=True, return_counts=True)
        keep = often[col] > 1
        order = np.argsort(col[keep], kind="stable")
        col, row = np.unique(col[keep][order], return_inverse=True)[1], row[keep][order]
        common = np.zeros((n, n), np.float32)
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            a, b = np.searchsorted(col, [at, at + 4096])
            hit = np.zeros((n, 4096), np.float32)
            hit[row[a:b], col[a:b] - at] = 1
            common += hit @ hit.T
        linked = 100 * common >= threshold * (size[:, None] + size[None, :] - common)
        if key[1] != key[2]:
            linked &= which[:, None] != which[None, :]
        x, y = np.nonzero(np.triu(linked & (comp[:, None] != comp[None, :]), 1))
        root = list(range(int(comp.max()) + 1))

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        names, out = part["cls"].to_numpy(), []
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            c, d = top(comp[p]), top(comp[q])
            if c != d:
                root[max(c, d)] = min(c, d)
                out.append((names[p], names[q]))
        return pd.DataFrame(out, columns=["x", "y"])

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "x binary, y binary")


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, th, n_shingles, cls, component_id, kept, comp``.

    Words are maximal runs of other than white space (A-Z lower-cased), a set holds the distinct five-word
    shingles, with fewer words the whole sequence; documents of similarity ``threshold`` percent or more are linked and
    ``component_id`` is the smallest doc_id reachable.  ``kept``: doc_id equals component_id.
    A null or empty text, or one of white space only, has an empty set, is linked with nothing and is its own
    component.  Repeated rows share their doc_id, so each says the same.  A null doc_id never names a component unless it is alone: 
    then component_id is null and the row counts as kept.  ``comp`` is the component's own identity (its smallest class,
    null for an empty set): components whose smallest doc_id is the same or null stay apart by it.  Other columns of ``documents``
    are not read.
    """
    rows = stored(sketch(documents, bands, width), "sketch")
    classes = (rows.where("cls is not null").groupBy("cls")
               .agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("low"),
                    F.min(F.struct("doc_id", "th")).alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")))
    classes = stored(classes, "classes")
    tables = stored(table_keys(classes), "tables")

    chosen = cut_lineage(tables.select("cls").distinct().join(classes.select("cls", "rep"), "cls")
                         .select("cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")))
    sets = stored(shingle_table(documents, chosen), "sets")

    star = (tables.where("cls != top").select(F.col("cls").alias("x"), F.col("top").alias("y"), F.col("n").alias("nx"))
            .distinct().join(classes.select(F.col("cls").alias("y"), F.col("n").alias("ny")), "y")
            .where(comparable(threshold)).select("x", "y"))
    first = stored(confirmed(star, sets, threshold), "links")
    part = cut_lineage(components(first))

    members = (tables.join(part.withColumnRenamed("node", "cls"), "cls", "left")
               .withColumn("comp", F.coalesce("comp", "cls")).select("key", "cls", "n", "m", "top", "comp"))
    members = stored(members, "members")
    mixed = cut_lineage(members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key"))
    members = members.join(mixed, "key", "left_semi")
    members = stored(members, "mixed")
    many = cut_lineage(members.where(F.col("m") > SMALL_BUCKET).groupBy("cls").agg(F.first("comp").alias("comp")))
    few = (members.where((F.col("m") <= SMALL_BUCKET) & (F.col("cls") != F.col("top")))
           .join(many.select("cls", F.lit(True).alias("hot")), "cls", "left"))
    side = lambda c: few.select("key", F.col("cls").alias(c), F.col("comp").alias(f"c{c}"),
                                F.col("n").alias(f"n{c}"), F.coalesce("hot", F.lit(False)).alias(f"h{c}"))
    cross = side("x").join(side("y"), "key").where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy"))
                                                   & ~(F.col("hx") & F.col("hy")) & comparable(threshold))
    second = confirmed(cross.select("x", "y").distinct(), sets, threshold)

    # classes of large buckets meet again under each key of the first collection: a superset of their pairs
    again = many.join(classes.select("cls", "a"), "cls").select("cls", "comp", F.posexplode("a").alias("at", "k"))
    again = stored(again.select("cls", "comp", F.xxhash64("at", "k").alias("key")), "again")
    size = cut_lineage(again.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                       .where("lo != hi").select("key", "m"))
    third = similar_in_blocks(again.join(size, "key").join(sets, "cls"), threshold)

    names = part.withColumnRenamed("node", "x").withColumnRenamed("comp", "cx")
    more = stored(second.unionByName(third), "more")
    lifted = (more.join(names, "x", "left").withColumn("x", F.coalesce("cx", "x")).select("x", "y")
              .join(part.select(F.col("node").alias("y"), F.col("comp").alias("cy")), "y", "left")
              .select("x", F.coalesce("cy", "y").alias("y")))
    whole = components(part.select(F.col("node").alias("x"), F.col("comp").alias("y")).unionByName(lifted))
    label = cut_lineage(whole.withColumnRenamed("node", "cls").join(classes.select("cls", "low"), "cls"))
    lowest = cut_lineage(label.groupBy("comp").agg(F.min("low").alias("component_id")))
    named = label.join(lowest, "comp").select("cls", "comp", "component_id")
    each = cut_lineage(classes.select("cls", "low").join(named, "cls", "left")
                       .select("cls", F.when(F.col("comp").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"),
                               F.coalesce("comp", "cls").alias("comp")))
    alone = rows.where("cls is null").withColumn("component_id", F.col("doc_id")).withColumn("comp", F.col("cls"))
    out = rows.where("cls is not null").join(each, "cls").unionByName(alone)
    return out.select("doc_id", "th", "n_shingles", "cls", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "comp")


def shingle_table(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """``cls, set`` of the classes in ``chosen(cls, doc_id, th)``, from the texts of their first documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, start, end = text_buffer(batch.column(1))
            for i, j in slices(start, end):
                sets = shingle_sets(buf, start[i:j], end[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cls", "set"])

    texts = documents.select(F.col("doc_id").cast("long").alias("d"), "text", text_hash().alias("h"))
    found = texts.join(chosen, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select("cls", "text")
    return found.mapInArrow(run, "cls binary, set array<long>").dropDuplicates(["cls"])


def deduplicate(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``documents`` with one row of each near-duplicate group, the one whose doc_id names the group.

    A group is a component, whatever ids its rows bear.  Rows without words all stay.  Rows that agree in doc_id and text are one
    document, of which one row stays; among different texts of a group with its doc_id (or, if all its ids are null, without one) the
    one with the smallest fingerprint stays.  All columns are kept as they are.
    """
    found = near_duplicates(documents, threshold)
    chosen = (found.where("kept and cls is not null").groupBy("comp", "component_id", "th").agg(F.count("*").alias("rows"))
              .groupBy("comp", "component_id").agg(F.min(F.struct("th", "rows")).alias("best"))
              .select(F.col("component_id").alias("id"), "best.th", "best.rows"))
    empty = found.where("cls is null").select(F.col("doc_id").alias("id"), "th").distinct().withColumn("rows", F.lit(1).cast("long"))
    chosen = cut_lineage(chosen.unionByName(empty))
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
                              F.col("doc_id").cast("long").alias("d"), text_hash().alias("h"))
    kept = packed.join(chosen, F.col("d").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th")))
    once = kept.where("rows = 1").select("row")
    return once.unionByName(kept.where("rows > 1").dropDuplicates(["d", "h"]).select("row")).select("row.*")
