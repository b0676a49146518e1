"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Only suffixes that can take part in a match are indexed.  Every window of ``length`` bytes is owned by its minimal
``GRAM``-byte substring (an *anchor*), so equal windows have equal anchors at equal offsets.  Anchors whose
substring occurs once in the corpus are dropped after one narrow aggregation; anchors whose whole owned stretch
recurs are decided by its fingerprint.  What is left, the rims of matches, is cut into pieces of up to ``SPAN``
windows and dealt to shards by the bytes that all windows of a piece share, so one hot passage spreads.

A shard takes its pieces in batches: each batch gets a suffix array (cut after ``length`` bytes), is merge-scanned against
the existing levels, and levels of like size merge geometrically.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import (U64, ByteHash, mix, slices, small_batches, spread, stored,
                                 text_buffer, text_hash)
from geoweave.session import cut_lineage

#: Bytes of a repeated string, of an anchor's substring, and windows in a piece.
LENGTH, GRAM, SPAN = 200, 48, 60
#: Pieces after which a task may start a new family of suffix arrays.
GROUP = 1000
#: Bytes hashed at once; a longer text is cut, with the cuts overlapping by a window.
SEGMENT = 300_000
#: Low bits of a hash that are replaced by the position (more than SEGMENT and its overlap).
PLACE = U64((1 << 24) - 1)


def anchors(buf: np.ndarray, start: np.ndarray, end: np.ndarray, length: int = LENGTH, gram: int = GRAM
            ) -> tuple[np.ndarray, ...]:
    """Anchors of the rows of one buffer: row, first owned window, number of owned windows, anchor's distance from
    the first window, anchor hash, hash of the whole owned stretch.  ``start``/``end`` are ascending."""
    lo, hi = int(start[0]), int(end[-1])
    data = ByteHash(buf[lo:hi])
    hashes = mix(data.rolling(gram))
    size, reach = len(hashes), length - gram + 1
    key = (hashes & ~PLACE) | np.arange(size, dtype=U64)
    padded = np.full(-(-size // reach) * reach, ~U64(0))
    padded[:size] = key
    block = padded.reshape(-1, reach)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(right[: size - reach + 1], left[reach - 1: size])
    count = np.maximum(end - start - length + 1, 0)
    row = np.repeat(np.arange(len(start)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (start - lo)[row]
    at = (lowest[window] & PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    head, tail, at = window[first], window[last], at[first]
    n, rel = tail - head + 1, at - head
    whole = mix(mix(data.of(head, tail + length)) + (n * 1024 + rel).astype(U64))
    return row[first], head + lo - start[row[first]], n, rel, hashes[at], whole


def anchor_table(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, th, lo, n, rel, h, c`` for every anchor of ``texts(doc_id, th, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, start, end = text_buffer(batch.column(2))
            ids, th = batch.column(0), batch.column(1)
            keep = np.flatnonzero(end - start >= length)
            for i, j in slices(start[keep], end[keep], SEGMENT):
                rows = keep[i:j]
                cuts = [(rows, start[rows], end[rows])]
                if end[rows[0]] - start[rows[0]] > 2 * SEGMENT:
                    cuts = [(rows[:1], np.array([s]), np.array([min(s + SEGMENT + length - 1, int(end[rows[0]]))]))
                            for s in range(int(start[rows[0]]), int(end[rows[0]]) - length + 1, SEGMENT)]
                    if len(rows) > 1:
                        cuts.append((rows[1:], start[rows[1:]], end[rows[1:]]))
                for own, s, e in cuts:
                    row, lo, n, rel, h, c = anchors(buf, s, e, length, gram)
                    take = pa.array(own[row])
                    lo = lo + (s - start[own])[row]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), th.take(take), pa.array(lo, pa.int32()), pa.array(n, pa.int16()),
                         pa.array(rel, pa.int16()), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))],
                        ["doc_id", "th", "lo", "n", "rel", "h", "c"])

    return texts.select("doc_id", "th", "text").mapInArrow(
        run, "doc_id long, th long, lo int, n short, rel short, h long, c long")


class SuffixLevels:
    """Logarithmic family of suffix arrays over windows of fixed length.

    A level holds distinct windows in lexicographic order with their owners; sizes at least double from level to level.
    """

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.matched: list[np.ndarray] = []

    def add(self, windows: np.ndarray, owner: np.ndarray) -> None:
        """Index a batch; owners of windows that occur twice, in the batch or before it, go to ``matched``."""
        order = np.argsort(windows, kind="stable")
        windows, owner = windows[order], owner[order]
        same = windows[1:] == windows[:-1]
        self.matched += [owner[1:][same], owner[:-1][same]]
        distinct = np.append(True, ~same)
        windows, owner = windows[distinct], owner[distinct]
        for known, whose in self.levels:
            at = np.minimum(np.searchsorted(known, windows), len(known) - 1)
            hit = known[at] == windows
            self.matched += [owner[hit], whose[at[hit]]]
            windows, owner = windows[~hit], owner[~hit]
        while len(windows) and self.levels and len(self.levels[-1][0]) <= 2 * len(windows):
            known, whose = self.levels.pop()
            at = np.searchsorted(known, windows) + np.arange(len(windows))
            old = np.ones(len(known) + len(windows), bool)
            old[at] = False
            merged = np.empty(len(old), windows.dtype)
            owners = np.empty(len(old), owner.dtype)
            merged[at], merged[old], owners[at], owners[old] = windows, known, owner, whose
            windows, owner = merged, owners
        if len(windows):
            self.levels.append((windows, owner))


def match_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key, ph, mask``: which windows of each distinct piece occur in another piece of its key.

    ``pieces``: ``key, ph, bytes``, one row per distinct piece.  Each task indexes the pieces of its keys batch by batch,
    keys in order, and starts a new family at the first new key after GROUP pieces, so memory follows the largest key.
    """
    def masks(family: SuffixLevels, names: list[pa.RecordBatch], done: int) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(done, np.int64)
        hit = np.unique(np.concatenate([np.zeros(0, np.int64), *family.matched]))
        np.bitwise_or.at(mask, hit // SPAN, np.left_shift(np.int64(1), hit % SPAN))
        table = pa.Table.from_batches(names).append_column("mask", pa.array(mask))
        return iter(table.filter(pa.array(mask != 0)).to_batches())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, names, done, last = SuffixLevels(length), [], 0, None
        for batch in batches:
            keys = np.asarray(batch.column(0))
            new = [int(k) for k in np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if k or keys[0] != last]
            at = 0
            while at < batch.num_rows:
                if done >= GROUP and at in new:
                    yield from masks(family, names, done)
                    family, names, done = SuffixLevels(length), [], 0
                end = next((k for k in new if k > at and done + k - at >= GROUP), batch.num_rows)
                windows, owner = [], []
                for k, raw in enumerate(batch.column(2)[at:end]):
                    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw.as_py(), np.uint8), length)
                    windows.append(view)
                    owner.append((done + k) * SPAN + np.arange(len(view)))
                family.add(np.ascontiguousarray(np.concatenate(windows)).view(f"S{length}").ravel(), np.concatenate(owner))
                names.append(batch.select([0, 1]).slice(at, end - at))
                done, at = done + end - at, end
            last = keys[-1] if len(keys) else last
        if done:
            yield from masks(family, names, done)

    n = spread(pieces.sparkSession)
    return pieces.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "key long, ph long, mask long")


def cut_pieces(affected: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, th, at, n, key, ph``: pieces of the wanted stretches of each affected text, by place and windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, th, text, want in zip(*(batch.column(k) for k in range(4)), strict=True):
                wanted = want.as_py()
                if not wanted:
                    continue
                raw, ids = text.as_py().encode(), (doc_id.as_py(), th.as_py())
                for w in wanted:
                    s, end, a, h = w["lo"], w["lo"] + w["n"], w["lo"] + w["rel"], w["h"] & (1 << 64) - 1
                    while s < end:
                        q = (a - s) // SPAN  # windows at distances q * SPAN .. q * SPAN + SPAN - 1 before the anchor
                        e = min(end - 1, a - q * SPAN)
                        core = raw[a - q * SPAN: a - q * SPAN - SPAN + 1 + length]
                        key = xxhash.xxh3_64_intdigest(core, h ^ q)
                        ph = xxhash.xxh3_64_intdigest(raw[s: e + length], (a - s) * 1024 + e - s)
                        rows.append((*ids, s, e - s + 1, key - (1 << 63), ph - (1 << 63)))
                        s = e + 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["doc_id", "th", "at", "n", "key", "ph"])

    return affected.select("doc_id", "th", "text", "want").mapInArrow(
        run, "doc_id long, th long, at int, n short, key long, ph long")


def piece_bytes(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key, ph, bytes`` of the pieces listed in ``texts(text, pieces)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, pieces in zip(*batch.columns, strict=True):
                raw = text.as_py().encode()
                rows += [(x["key"], x["ph"], raw[x["at"]: x["at"] + x["n"] - 1 + length]) for x in pieces.as_py()]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["key", "ph", "bytes"])

    return texts.select("text", "pieces").mapInArrow(run, "key long, ph long, bytes binary")


def repeats(documents: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """What is left of each text that has repeated strings: ``doc_id, th, n_removed, n_spans, kept_sha256`` and ``kept_text``.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere - in any document, the same one included,
    overlapping or not - is removed; strings are judged on the whole input.  ``doc_id`` and the fingerprint ``th`` identify a text: repeated
    rows are documents of their own, so each makes the other's strings repeated, and share one row of this result.
    Texts without such strings (null, empty and short ones too) have no row.  ``kept_text`` drops what is left of a cut UTF-8 character.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"),
                             F.coalesce("text", F.lit("")).alias("text"))
    # the anchors are computed twice rather than stored: they are many, and most of them occur once
    often = cut_lineage(anchor_table(texts, length).groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"))
    found = stored(anchor_table(texts, length).join(often, "h"), "repeated")

    classes = stored(found.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "th", "lo")).alias("rep")),
                     "stretches")
    varied = cut_lineage(classes.groupBy("h").count().where("count > 1").select("h", F.lit(True).alias("varied")))
    classes = cut_lineage(classes.join(varied, "h", "left").select("h", "c", "times", "rep", "varied"))
    each = found.join(classes, ["h", "c"])
    first = (F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.th") == F.col("th")) & (F.col("rep.lo") == F.col("lo")))
    lists = (each.select("doc_id", "th", F.struct("lo", "n", "rel", "h").alias("x"), (F.col("times") > 1).alias("full"),
                         (F.col("varied") & first).alias("want"))
             .where("full or want").groupBy("doc_id", "th")
             .agg(F.collect_set(F.when(F.col("full"), F.struct("x.lo", "x.n"))).alias("full"),
                  F.collect_set(F.when(F.col("want"), F.struct("x.lo", "x.n", "x.rel", "x.h"))).alias("want")))
    lists = cut_lineage(lists.withColumnsRenamed({"doc_id": "d", "th": "t"}))
    affected = stored(texts.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
                      .drop("d", "t"), "affected")

    pieces = stored(cut_pieces(affected, length), "pieces")
    kinds = cut_lineage(pieces.groupBy("key", "ph").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "th", "at", "n")).alias("rep")))
    mixed = cut_lineage(kinds.groupBy("key").count().where("count > 1").select("key"))
    wanted = cut_lineage(kinds.join(mixed, "key", "left_semi").groupBy(F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("t"))
                         .agg(F.collect_list(F.struct("rep.at", "rep.n", "key", "ph")).alias("pieces")))
    rims = affected.select("doc_id", "th", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    masks = (kinds.where("times > 1").select("key", "ph", F.lit(-1).cast("long").alias("mask"))
             .unionByName(match_pieces(piece_bytes(rims, length), length)).groupBy("key", "ph").agg(F.bit_or("mask").alias("mask")))
    masks = cut_lineage(masks)
    hits = (pieces.join(masks, ["key", "ph"])
            .select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.struct("at", "n", "mask").alias("hit")))
    hits = cut_lineage(hits.groupBy("d", "t").agg(F.collect_list("hit").alias("hits")))
    ready = (affected.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
             .select("doc_id", "th", "text", "full", "hits"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, th, text, full, hits in zip(*batch.columns, strict=True):
                raw = text.as_py().encode()
                begin = np.zeros(len(raw) + 1, np.int32)  # windows that begin minus windows that ended
                for x in full.as_py():
                    begin[x["lo"]] += 1
                    begin[x["lo"] + x["n"] - 1 + length] -= 1
                for x in hits.as_py() or []:
                    for k in range(x["n"]):
                        if x["mask"] >> k & 1:
                            begin[x["at"] + k] += 1
                            begin[x["at"] + k + length] -= 1
                gone = np.cumsum(begin[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((doc_id.as_py(), th.as_py(), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(),
                             left.decode("utf-8", "ignore") if with_text else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["doc_id", "th", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    out = "doc_id long, th long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return stored(ready.mapInArrow(remove, out), "left").dropDuplicates(["doc_id", "th"])


def repeat_digest(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (a null text counts as empty)."""
    found = cut_lineage(repeats(documents, length).drop("kept_text").withColumnsRenamed({"doc_id": "d", "th": "t"}))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"),
                            F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"))
    return (base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
            .select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                    F.coalesce("kept_sha256", "sha").alias("kept_sha256")))


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` with every repeated string of ``length`` bytes taken out of ``text`` (and ``n_chars`` recounted, if present).

    All rows and columns stay; a null text stays null; a text that is all repeats becomes empty.
    """
    found = (repeats(documents, length, with_text=True).where("n_removed > 0")
             .select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("kept_text").alias("left_text")))
    found = cut_lineage(found)
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
                              F.col("doc_id").cast("long").alias("id"), text_hash().alias("th"))
    joined = packed.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    text = F.coalesce("left_text", "row.text")
    new = {"text": text, "n_chars": F.when(F.col("left_text").isNull(), F.col("row.n_chars")).otherwise(
        F.length("left_text").cast(dict(documents.dtypes).get("n_chars", "long")))} if "n_chars" in documents.columns else {"text": text}
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
