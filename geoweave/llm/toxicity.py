"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A short window of words compresses better with the dictionary of the class that it resembles.  The ordinary dictionary
holds the words that ordinary documents use most; the toxic one the same words and, nearest to the window, those that
toxic documents use significantly more often.  Near copies in the sample are set aside first: their chance words
would pass for typical ones.  Length differences over all windows of a whole text, in two independent
views (dictionary size and window phase), are calibrated to a probability on the sample, weighted to the class ratio of
all labels.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import small_batches, text_buffer
from geoweave.llm.minhash import shingle_sets, signatures
from geoweave.llm.samples import Logistic, fold, labelled_sample

#: Bounds of the labelled sample (documents of each class, characters of a document) and the held-out fold.
TOXIC, ORDINARY, MAX_CHARS = 2000, 6000, 20_000
FOLDS, HELD_OUT = 3, 1
#: Words in a window; common words in the dictionaries and first window's words, for each view.
WINDOW = 8
VIEWS = ((1000, 0), (1500, 4))
#: A word is typical of toxic text from this z-score of its document frequencies; at most so many are kept.
TYPICAL, MOST_TYPICAL = 6.0, 2000
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def without_copies(texts: list[str]) -> list[int]:
    """Indices of texts that share no minhash key with an earlier one; a few texts at a time are hashed."""
    out: list[int] = []
    seen: set[tuple[int, int]] = set()
    for at in range(0, len(texts), 200):
        sets = shingle_sets(*text_buffer(pa.array(texts[at: at + 200], pa.string())))
        full = [i for i, s in enumerate(sets) if len(s)]
        if not full:
            continue
        for i, keys in zip(full, signatures([sets[i] for i in full], 8, 2)[1].tolist(), strict=True):
            own = set(enumerate(keys))
            if not own & seen:
                out.append(at + i)
            seen |= own
    return out


def document_frequencies(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        out.update(set(tokens(t)))
    return out


def dictionaries(bad: Counter, n: int, good: Counter, m: int, common: int) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary, from document frequencies among ``n`` toxic and ``m`` ordinary
    texts; the strongest strings stand last, nearest to the data."""
    def z(w: str) -> float:
        p = (bad[w] + good[w]) / (n + m)
        return (bad[w] / n - good[w] / m) / max(1e-9, (p * (1 - p) * (1 / n + 1 / m)) ** 0.5)

    typical = sorted((w for w, k in bad.items() if k > 2 and z(w) > TYPICAL), key=lambda w: (z(w), w))[-MOST_TYPICAL:]
    base = heapq.nlargest(common, good, key=lambda w: (good[w], w))[::-1]
    shared = " " + " ".join(w for w in base if w not in set(typical)) + " "
    return (shared + " ".join(typical) + " ").encode(), shared.encode()


@cache
def compressor(content: bytes) -> zs.ZstdCompressor:
    """Compressor for short windows against raw dictionary content."""
    settings = zs.ZstdCompressionParameters(
        window_log=17, hash_log=14, chain_log=15, search_log=6, min_match=4, target_length=32, strategy=zs.STRATEGY_GREEDY,
        format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
    return zs.ZstdCompressor(compression_params=settings, dict_data=zs.ZstdCompressionDict(
        content, dict_type=zs.DICT_TYPE_RAWCONTENT))


class _Lengths(dict):
    """``window -> bytes saved by the toxic dictionary``; each distinct window is compressed once."""

    def __init__(self, bad: bytes, good: bytes):
        super().__init__()
        self.bad, self.good = compressor(bad).compress, compressor(good).compress

    def __missing__(self, window: str) -> int:
        raw = window.encode()
        self[window] = saved = len(self.good(raw)) - len(self.bad(raw))
        return saved


def distances(text: str, pairs: list[tuple[bytes, bytes]], known: list[_Lengths] | None = None) -> list[float]:
    """Features of a text's windows: how much shorter each gets with the toxic dictionary, in every view.

    ``known`` keeps windows between the texts of a batch.
    """
    words, out = tokens(text), []
    for k, (_, phase) in enumerate(VIEWS):
        saved = known[k] if known else _Lengths(*pairs[k])
        parts = [words[:phase], *(words[i: i + WINDOW] for i in range(phase, len(words), WINDOW))]
        d = np.array([saved[f" {' '.join(p)} "] for p in parts if p] or [0])
        top = np.sort(d)[::-1]
        out += [min(top[0], 10), min(top[:2].sum(), 16), min(top[:4].sum(), 30), np.clip(d.mean(), -2, 3), (d >= 2).mean(),
                (d >= 3).mean(), (d >= 4).mean(), (d < 0).mean(), np.log1p(len(d)), np.log1p((d >= 3).sum()),
                np.log1p((d >= 4).sum()), np.log1p((d >= 5).sum()), np.maximum(d - 1, 0).mean()]
    return [float(x) for x in out]


class Toxicity:
    """Fitted dictionaries and calibration.  Without both classes in the sample every score is 0."""

    def __init__(self, documents: DataFrame, labels: DataFrame):
        small_batches(documents.sparkSession)
        sample = labelled_sample(documents, labels, "toxic", FOLDS, HELD_OUT, TOXIC, ORDINARY, MAX_CHARS)
        ids, toxic, ordinary = [], [], []
        for r in sample.orderBy("doc_id").toLocalIterator():  # bounded by TOXIC, ORDINARY and MAX_CHARS
            ids.append(r.doc_id)
            (toxic if r.y == 1 else ordinary).append((r.doc_id, r.text))
        texts = dict(toxic + ordinary)
        kept = {ids[i] for i in without_copies([texts[i] for i in ids])}
        toxic, ordinary = ([t for i, t in part if i in kept] for part in (toxic, ordinary))
        self.pairs: list[tuple[bytes, bytes]] = []
        self.model: Logistic | None = None
        if not toxic or not ordinary:
            return
        bad, good = document_frequencies(toxic), document_frequencies(ordinary)
        self.pairs = [dictionaries(bad, len(toxic), good, len(ordinary), common) for common, _ in VIEWS]
        del texts, toxic, ordinary, bad, good  # the fit needs features only
        found = [r for r in scored(sample, ["doc_id", "y", "weight"], self.pairs, None).toLocalIterator() if r.doc_id in kept]
        self.model = Logistic(*(np.array([r[c] for r in found]) for c in ("features", "y", "weight")))

    def scores(self, documents: DataFrame, columns: list[str]) -> DataFrame:
        """``columns`` of ``documents`` and ``score``."""
        return scored(documents, columns, self.pairs, self.model)


def scored(documents: DataFrame, columns: list[str], pairs: list[tuple[bytes, bytes]], model: Logistic | None) -> DataFrame:
    """``columns`` and the calibrated ``score``, or without a model the ``features``, of every whole text."""
    frame = documents.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("whole text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(len(columns))]
            known = [_Lengths(*pair) for pair in pairs]
            x = [distances(t, pairs, known) for t in texts] if pairs else []
            if pairs and model is None:
                extra, name = pa.array(x, pa.list_(pa.float64())), "features"
            else:
                score = model.score(np.array(x).reshape(batch.num_rows, -1)) if pairs and x else np.zeros(batch.num_rows)
                blank = np.array([not LETTERS.search(t) for t in texts], bool)
                extra, name = pa.array(np.where(blank, 0.0, score)), "score"
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], extra], [*columns, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{kinds}, " + ("features array<double>" if pairs and model is None else "score double"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; ``predicted`` is 1 from a score of THRESHOLD.

    Null, empty and letterless texts score 0; repeated rows score alike; a null doc_id is scored and not held out.  Only
    ``text`` is an input of a score.
    """
    out = Toxicity(documents, labels).scores(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    return out.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those that score THRESHOLD or more; rows without text stay."""
    columns = documents.columns
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    return Toxicity(documents, labels).scores(packed, ["row"]).where(F.col("score") < THRESHOLD).select("row.*")
