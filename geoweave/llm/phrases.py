"""Phrase collocations per language: an FM-index per shard of word ids, n-gram counts summed across the shards.

Documents of one language and partition form shards of a bounded number of words.  A shard keeps its own vocabulary and its
text as word ids.  The text is indexed in both directions by a BWT sorted to the longest phrase's depth; intervals are
extended by one word at a time, to the right in the reversed text's index and to the left in the text's own, which
enumerates every phrase with its count in the shard.

Counts are summed in two rounds, pairs first, then phrases of three words and more in what is left of the text when pairs
below ``least`` occurrences in the language have become breaks (no longer candidate can hold them).  In a round a shard deals
the 96-bit fingerprints of its phrases and their counts to hash ranges, in packed rows; a range sums all shards' counts and
answers each with the places of the frequent ones; the first shard that holds a frequent phrase spells it out.  Shuffled bytes
follow the number of words, whatever the share of frequent ones.

A task holds one shard (at most ``SHARD_WORDS`` words, or one document) or one range (about ``RANGE_KEYS`` fingerprints).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import U64, mix, slices, small_batches, stored

#: Words of one shard; a longer document makes a shard of its own.
SHARD_WORDS = 1_500_000
#: Words that a task holds in unfinished shards of all its languages.
OPEN_WORDS = 2_500_000
#: Rows of an index that are extended at a time.
CHUNK_ROWS = 400_000
#: Phrase fingerprints that one range sums at a time, about.
RANGE_KEYS = 400_000

#: Lower-cases A-Z, turns every piece separator into a full stop and a tab into a space.
_TABLE = bytes(32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))

SHARD = "shard long, lang string, n long, words array<string>, counts array<long>, ids binary"
KEYS = "part long, shard long, high binary, low binary, n binary"
KEPT = "of long, part long, kept binary, owned binary, totals binary"
FOUND = "shard long, lang string, words array<string>, ids binary, k int, phrase string, a long"


class _Vocabulary(dict):
    """Word to id in order of appearance; the piece break is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


class _Builder:
    def __init__(self) -> None:
        self.vocabulary, self.parts, self.size = _Vocabulary(), [], 0

    def add(self, text: str) -> int:
        tokens = text.encode().translate(_TABLE).replace(b".", b" . ").split()
        ids = np.fromiter(map(self.vocabulary.__getitem__, tokens), np.uint32, len(tokens))
        self.parts.append(np.append(ids, np.uint32(0)))
        self.size += len(ids)
        return len(ids)

    def row(self, shard: int, lang: str) -> list:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.vocabulary))[1:]
        return [shard, lang, int(counts.sum()), [w.decode() for w in list(self.vocabulary)[1:]], counts, pack(ids)]


def pack(ids: np.ndarray) -> bytes:
    """Word ids as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress(ids.astype(np.uint32).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32).astype(np.int64)


def _record(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``lang, text`` to shard rows, one batch each; texts are whole, a shard ends with a document."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())),
                        ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])
    first, made, held = TaskContext.get().partitionId() << 32, 0, 0
    open_: dict[str, _Builder] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            builder = open_.setdefault(lang.as_py(), _Builder())
            held += builder.add(text.as_py())
            full = lang.as_py() if builder.size >= SHARD_WORDS else None
            if full is None and held > OPEN_WORDS:
                full = max(open_, key=lambda x: open_[x].size)
            if full is not None:
                held -= open_[full].size
                yield _record([open_.pop(full).row(first + made, full)], schema)
                made += 1
    for lang, builder in open_.items():
        yield _record([builder.row(first + made, lang)], schema)
        made += 1


class Bwt:
    """BWT of a text whose suffixes are sorted by their first ``depth`` symbols; exact for patterns of that length."""

    def __init__(self, text: np.ndarray, depth: int, symbols: int):
        n = len(text)
        rank, width = text, 1
        while width < depth:
            step = min(width, depth - width)
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:]
            key = rank * (int(rank.max()) + 2) + ahead + 1
            if width + step >= depth:
                rank = key
            else:
                order = np.argsort(key, kind="stable")
                new = np.empty(n, np.int64)
                new[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
                rank = new
            width += step
        order = np.argsort(rank, kind="stable")
        del rank
        self.bwt = text[order - 1]  # the symbol before each suffix; before the first stands the closing break
        self.first = np.searchsorted(text[order], np.arange(symbols + 1))
        at = np.argsort(self.bwt, kind="stable")
        self.size = n + 1
        self.places = self.bwt[at] * self.size + at

    def extended(self, symbol: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """First row of symbol + P for patterns P whose rows start at ``lo`` (backward search)."""
        before = np.searchsorted(self.places, symbol * self.size + lo) - np.searchsorted(self.places, symbol * self.size)
        return self.first[symbol] + before


class BidirectionalIndex:
    """FM-index of a text and of its reverse with synchronised intervals."""

    def __init__(self, text: np.ndarray, depth: int, symbols: int):
        self.text, self.depth, self.symbols = text, depth, symbols
        self.sides: dict[bool, Bwt] = {}

    def side(self, left: bool) -> Bwt:
        if left not in self.sides:  # the reverse keeps a closing break, as the text has one
            text = self.text if left else np.append(self.text[:-1][::-1], 0)
            self.sides[left] = Bwt(text, self.depth, self.symbols)
        return self.sides[left]

    def extend(self, lo: np.ndarray, other: np.ndarray, size: np.ndarray, left: bool
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All one-word extensions of patterns by a word on one side.

        ``lo`` starts the patterns' rows in that side's index, ``other`` in the other side's.  Returns (pattern, word, lo,
        other, size) of each extension; breaks are counted in the other side's order but never extended over.
        """
        bwt = self.side(left)
        parts = []
        for i, j in slices(np.zeros(len(lo), np.int64), size, CHUNK_ROWS):  # a pattern's rows stay together
            row = np.repeat(lo[i:j] - np.r_[0, np.cumsum(size[i:j])[:-1]], size[i:j]) + np.arange(int(size[i:j].sum()))
            parts.append(np.unique(np.repeat(np.arange(i, j) * self.symbols, size[i:j]) + bwt.bwt[row], return_counts=True))
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        pattern, word = key // self.symbols, key % self.symbols
        start = np.searchsorted(pattern, np.arange(len(lo)))
        total = np.r_[0, np.cumsum(n)]
        smaller = total[:-1] - total[start[pattern]]  # extensions of the same pattern by smaller symbols
        real = word > 0
        pattern, word, n, smaller = pattern[real], word[real], n[real], smaller[real]
        return pattern, word, bwt.extended(word, lo[pattern]), other[pattern] + smaller, n


def enumerate_phrases(text: np.ndarray, depth: int, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(words, counts)`` of all phrases of 2, 3, .. ``depth`` words; words has a row per phrase, breaks are never crossed.

    Even lengths come from extensions to the right, odd ones from extensions to the left.
    """
    index = BidirectionalIndex(text, depth, symbols)
    first = index.side(False).first
    words = np.arange(1, symbols)
    left = right = first[1:-1]
    size = first[2:] - left
    some = size > 0
    words, left, right, size = words[some][:, None], left[some], right[some], size[some]
    for k in range(2, depth + 1):
        if k % 2:
            pattern, word, left, right, size = index.extend(left, right, size, True)
            words = np.c_[word, words[pattern]]
        else:
            pattern, word, right, left, size = index.extend(right, left, size, False)
            words = np.c_[words[pattern], word]
        yield words, size
        if not len(size):
            return


def _strings(vocabulary: pa.Array, words: np.ndarray) -> pa.Array:
    """Space-joined phrases of word ids (1 is the vocabulary's first word)."""
    return pc.binary_join_element_wise(*(vocabulary.take(pa.array(words[:, i] - 1)) for i in range(words.shape[1])), " ")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an array with bytes of equal weight together, which compresses sorted numbers."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


class ShardText:
    """A shard's vocabulary and word ids, its phrases and their fingerprints."""

    def __init__(self, lang: str, words: pa.Array, ids: bytes):
        self.lang, self.words, self.ids = lang, words, unpack(ids)
        raw = b"".join(map(xxhash.xxh3_128_digest, words.to_pylist()))
        both = np.frombuffer(raw, U64).reshape(-1, 2)
        self.one, self.two = (np.append(U64(0), both[:, i]) for i in (0, 1))

    def phrases(self, shortest: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k, (words, counts) in enumerate(enumerate_phrases(self.ids, longest, len(self.words) + 1), 2):
            if k >= shortest and len(counts):
                yield words, counts

    def fingerprints(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of each phrase, its length and its language."""
        seed = xxhash.xxh3_64_intdigest(self.lang, words.shape[1])
        high = np.full(len(words), seed, U64)
        low = ~high
        for i in range(words.shape[1]):
            high = mix(high * U64(0x9FB21C651E98DF25) + self.one[words[:, i]])
            low = mix(low * U64(0xD6E8FEB86659FD93) + self.two[words[:, i]])
        return high, (low >> U64(32)).astype(np.uint32)

    def dealt(self, words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order of the phrases by fingerprint, the ordered fingerprints and each one's range."""
        high, low = self.fingerprints(words)
        order = np.argsort(high, kind="stable")
        high = high[order]
        return order, high, low[order], (((high >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def emit_keys(shortest: int, longest: int, parts: int):
    """Packed fingerprints and counts of each shard's phrases, a row for each range and phrase length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("n", pa.binary())])
        for batch in batches:
            for at in range(batch.num_rows):
                shard, lang, ids = (batch.column(c)[at].as_py() for c in ("shard", "lang", "ids"))
                text = ShardText(lang, batch.column("words")[at].values, ids)
                for words, counts in text.phrases(shortest, longest):
                    order, high, low, part = text.dealt(words, parts)
                    counts = counts[order].astype(U64)
                    cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
                    # ranges of a length are told apart by it, so that a shard's answers can be matched
                    rows = [[int(part[i]) * (longest + 1) + words.shape[1], shard, _planes(high[i:j]), _planes(low[i:j]), _planes(counts[i:j])]
                            for i, j in zip(cut[:-1], cut[1:], strict=True)]
                    for i in range(0, len(rows), 1000):
                        yield _record(rows[i:i + 1000], schema)
    return run


def sum_range(least: int):
    """Frequent fingerprints of one range: for each shard the places it holds, those it is first to hold, and their totals."""
    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("of", pa.int64()), ("part", pa.int64()), ("kept", pa.binary()), ("owned", pa.binary()), ("totals", pa.binary())])
        order = np.argsort(table.column("shard").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        high, low, n = ([_from_planes(x.as_py(), kind) for x in table.column(c)] for c, kind in
                        (("high", U64), ("low", np.uint32), ("n", U64)))
        sizes = np.array([len(x) for x in high])
        high, low, n = np.concatenate(high), np.concatenate(low), np.concatenate(n).astype(np.int64)
        order = np.lexsort((np.arange(len(high)), low, high))
        high, low = high[order], low[order]
        new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        total = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        kept, owned, totals = np.zeros(len(n), bool), np.zeros(len(n), bool), np.zeros(len(n), np.int64)
        kept[order] = total >= least
        owned[order] = new & (total >= least)
        totals[order] = total
        rows, end = [], 0
        for shard, part, size in zip(table.column("shard").to_pylist(), table.column("part").to_pylist(), sizes, strict=True):
            k, o, t = kept[end:end + size], owned[end:end + size], totals[end:end + size]
            end += size
            if k.any():
                rows.append([shard, part, np.packbits(k).tobytes(), np.packbits(o).tobytes(), t[o].tobytes()])
        return pa.Table.from_batches([_record(rows, schema)])
    return run


def spell(shortest: int, longest: int, parts: int, narrow: bool):
    """Rows of the frequent phrases that a shard owns; with ``narrow`` also the shard's text cut down to frequent pairs."""
    def run(shards: pa.Table, kept: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("ids", pa.binary()),
                            ("k", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())])
        out = []
        if not shards.num_rows or not kept.num_rows:
            return schema.empty_table()
        shard, lang, ids = (shards.column(c)[0].as_py() for c in ("shard", "lang", "ids"))
        text = ShardText(lang, shards.column("words")[0].values, ids)
        answers = {r["part"]: r for r in kept.to_pylist()}
        for words, _ in text.phrases(shortest, longest):
            order, _, _, part = text.dealt(words, parts)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            good, own, totals = [], [], []
            for i, j in zip(first, np.r_[first[1:], len(part)], strict=True):
                r = answers.get(int(part[i]) * (longest + 1) + words.shape[1])
                if r is not None:
                    k, o = (np.unpackbits(np.frombuffer(r[c], np.uint8), count=j - i).astype(bool) for c in ("kept", "owned"))
                    good.append(order[i:j][k])
                    own.append(order[i:j][o])
                    totals.append(np.frombuffer(r["totals"], np.int64))
            if not good:
                continue
            good, own, totals = np.concatenate(good), np.concatenate(own), np.concatenate(totals)
            n = len(own)
            out.append(pa.Table.from_arrays([
                pa.repeat(shard, n), pa.repeat(lang, n).cast(pa.string()), pa.nulls(n, schema.field("words").type), pa.nulls(n, pa.binary()),
                pa.repeat(pa.scalar(words.shape[1], pa.int32()), n), _strings(text.words, words[own]).cast(pa.string()),
                pa.array(totals, pa.int64())], schema=schema))
            if narrow:
                ids, vocabulary = narrowed(text, words[good])
                row = [shard, lang, vocabulary, pack(ids), None, None, None]
                out.append(pa.Table.from_batches([_record([row], schema)]))
        return pa.concat_tables(out) if out else schema.empty_table()
    return run


def narrowed(text: ShardText, pairs: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The shard's text cut at all pairs but the given ones, over the words that are left."""
    ids, symbols = text.ids, len(text.words) + 1
    good = np.sort(pairs[:, 0] * symbols + pairs[:, 1])
    pair = np.r_[ids[:-1] * symbols + ids[1:], 0]
    at = np.minimum(np.searchsorted(good, pair), len(good) - 1)
    ids = split_runs(ids, (ids > 0) & (np.r_[ids[1:], 0] > 0) & (good[at] == pair))
    used = np.unique(ids[ids > 0])
    new = np.zeros(symbols, np.int64)
    new[used] = np.arange(1, len(used) + 1)
    return new[ids], text.words.take(pa.array(used - 1)).to_pylist()


def split_runs(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Text cut wherever a word is not linked to its right neighbour; runs of fewer than three words go, as they hold no longer phrase."""
    n = len(ids)
    inner = linked | np.r_[False, linked[:-1]]
    start = inner & ~np.r_[False, linked[:-1]]
    run = np.cumsum(start)
    length = np.bincount(run[inner], minlength=int(run[-1]) + 1 if n else 1)
    stay = inner & (length[run] >= 3)
    kept, heads = ids[stay], np.flatnonzero(start[stay])
    return np.append(np.insert(kept, heads, 0)[1:], 0) if len(kept) else np.zeros(1, np.int64)


def _words(phrase: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def phrase_counts(documents: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, k, phrase, a)`` of all words and phrases of at least ``least`` occurrences, and ``(lang, n)`` word totals."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    shards = stored(texts.mapInArrow(build_shards, SHARD), "phrase-shards")
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = max(8, (shards.agg(F.sum("n")).first()[0] or 0) // RANGE_KEYS)
    words = (shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
             .groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("a")).where(F.col("a") >= least))

    def counted(texts: DataFrame, shortest: int, longest: int, narrow: bool) -> DataFrame:
        texts = texts.select("shard", "lang", "words", "ids")
        kept = (texts.mapInArrow(emit_keys(shortest, longest, parts), KEYS).groupBy("part").applyInArrow(sum_range(least), KEPT))
        return stored(texts.groupBy("shard").cogroup(kept.groupBy("of"))
                      .applyInArrow(spell(shortest, longest, parts, narrow), FOUND), "phrase-counts")

    pairs = counted(shards, 2, 2, True)
    counts = words.select("lang", F.lit(1).alias("k"), "phrase", "a").unionByName(pairs.where("k = 2").select("lang", "k", "phrase", "a"))
    if longest > 2:
        more = counted(pairs.where("ids is not null"), 3, longest, False)
        counts = counts.unionByName(more.select("lang", "k", "phrase", "a"))
    return stored(counts, "phrases"), totals


def collocations(documents: DataFrame, longest: int = 5, least: int = 100, held: int = 100, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases.

    A phrase of 2 to ``longest`` words within a piece counts with ``a >= least`` occurrences.  Its score is that of its weakest
    cut, ``floor(1000 * a * n / (l * r))`` in exact decimals, ties to the earliest cut.  A phrase is dropped if a candidate one
    word longer (hence any longer one) holds it with ``100 * f >= held * a``.  ``top`` rows a language by score, a and phrase.
    Null or empty texts hold no words; a null lang is ``und``; repeated rows count each; an empty table gives no rows; a text of
    any length is read whole; other columns are not read.
    """
    counts, totals = phrase_counts(documents, longest, least)
    candidates = counts.where(F.col("k") > 1)
    ends = candidates.where(F.col("k") > 2).select(
        "lang", F.explode(F.array(_words(F.col("phrase"), F.lit(1), F.col("k") - 1), _words(F.col("phrase"), F.lit(2), F.col("k") - 1)))
        .alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = (candidates.join(ends, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * held)).drop("longer"))
    part = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = (cuts.withColumn("part", _words(F.col("phrase"), F.lit(1), F.col("cut")))
            .join(part.withColumnRenamed("f", "l"), ["lang", "part"])
            .withColumn("part", _words(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")))
            .join(part.withColumnRenamed("f", "r"), ["lang", "part"]).drop("part")
            .join(totals, "lang"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "lr"} | {c: F.col(c).cast("decimal(17,0)") for c in "an"}
    cuts = cuts.withColumns({"over": wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)"), "under": wide["l"] * wide["r"]})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
                          F.col("best.score").alias("score"))
            .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
