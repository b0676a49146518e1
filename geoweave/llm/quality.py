"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics are Spark columns.  Small trees are boosted on the statistics of a bounded labelled sample, every path
from a root becomes a rule, a lasso logistic regression keeps few of them, and the kept rules are
compiled back into one Spark column expression, so scoring runs without Python.  The sample's rows are weighted to the class ratio
of all labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.samples import fold, labelled_sample, unit_mean

#: Bounds of the labelled sample (documents of each class, characters of a document) and the held-out fold.
GOOD, POOR, MAX_CHARS = 8000, 4000, 200_000
FOLDS, HELD_OUT = 4, 2
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 3, 0.3, 32, 8
THRESHOLD = 0.7

#: Fixed character classes of the statistics.
CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "symbol": "#$%&*@^~|<>{}[]_=+\\/",
           "exclaim": "!?", "stop": ".,;:", "space": " ", "newline": "\n"}


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; a null text counts as empty, shares of nothing are 0."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    out = {f"{name}_share": per(chars - F.length(F.translate(text, own, "")), chars) for name, own in CLASSES.items()}
    n, m = F.size(words), F.size(lines)
    out |= {"chars": chars.cast("double"), "words": n.cast("double"), "word_length": per(chars, n),
            "distinct_words": per(F.size(F.array_distinct(words)), n), "distinct_lines": per(F.size(F.array_distinct(lines)), m),
            "line_words": per(n, m)}
    return out


@dataclass(frozen=True)
class Rule:
    """Conjunction of ``(statistic, above, cut)`` conditions."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = None
        for name, above, cut in self.conditions:
            one = x[name] > cut if above else x[name] <= cut
            out = one if out is None else out & one
        return out

    def column(self, x: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, cut in self.conditions:
            out = out & (x[name] > F.lit(cut) if above else x[name] <= F.lit(cut))
        return out


def boosted_rules(x: np.ndarray, y: np.ndarray, names: list[str], weights: np.ndarray | None = None) -> list[Rule]:
    """Rules of all inner and leaf paths of boosted regression trees on logistic gradients of weighted rows."""
    own = unit_mean(np.ones(len(y)) if weights is None else weights)
    mean = np.average(y, weights=own)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    f = np.full(len(y), np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    rules: dict[frozenset, Rule] = {}

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, path: tuple, depth: int, out: np.ndarray) -> None:
        best = None
        if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            gr, hr = g[rows], h[rows]
            base = gr.sum() ** 2 / (hr.sum() + 1)
            for k, at in enumerate(cuts):
                bins = np.searchsorted(at, x[rows, k])  # bin j holds values in (at[j - 1], at[j]]
                n = np.cumsum(np.bincount(bins, minlength=len(at) + 1))[:-1]
                gs = np.cumsum(np.bincount(bins, gr, len(at) + 1))[:-1]
                hs = np.cumsum(np.bincount(bins, hr, len(at) + 1))[:-1]
                gain = gs ** 2 / (hs + 1) + (gr.sum() - gs) ** 2 / (hr.sum() - hs + 1) - base
                gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = -1
                if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                    best = (gain.max(), k, float(at[int(gain.argmax())]))
        if path:
            rules.setdefault(frozenset(path), Rule(tuple(path)))
        if best is None:
            out[rows] = g[rows].sum() / (h[rows].sum() + 1)
            return
        _, k, cut = best
        low = x[rows, k] <= cut
        grow(rows[low], g, h, (*path, (names[k], False, cut)), depth + 1, out)
        grow(rows[~low], g, h, (*path, (names[k], True, cut)), depth + 1, out)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), own * (y - p), own * p * (1 - p), (), 0, step)
        f = f + RATE * step
    return list(rules.values())


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 300,
          weights: np.ndarray | None = None) -> np.ndarray:
    """Intercept and weights of an L1-penalised logistic regression of weighted rows by accelerated proximal gradient steps."""
    z = np.c_[np.ones(len(r)), r]
    own = unit_mean(np.ones(len(y)) if weights is None else weights)
    rate = 4 * len(z) / np.linalg.norm(z * np.sqrt(own)[:, None], 2) ** 2
    w = np.zeros(z.shape[1]) if start is None else start.copy()
    v, t = w.copy(), 1.0
    for _ in range(steps):
        grad = z.T @ (own * (1 / (1 + np.exp(-np.clip(z @ v, -30, 30))) - y)) / len(z)
        new = v - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return w


class Quality:
    """Fitted rules with weights.  Without both classes in the sample every score is the prior of what there is (0.5 if nothing)."""

    def __init__(self, documents: DataFrame, labels: DataFrame):
        sample = labelled_sample(documents, labels, "quality", FOLDS, HELD_OUT, GOOD, POOR, MAX_CHARS)
        stats = statistics(F.col("text"))
        self.names = list(stats)
        rows = sample.select("doc_id", "y", "weight", *[c.alias(n) for n, c in stats.items()]).orderBy("doc_id").collect()
        y, k = np.array([r.y for r in rows], float), np.array([r.weight for r in rows], float)
        self.rules: list[tuple[Rule, float]] = []
        self.intercept = 0.0
        if len(set(y.tolist())) < 2:
            self.intercept = {0: 0.0, 1: 4.0, -1: -4.0}[int(np.sign(y.mean() - 0.5)) if len(y) else 0]
            return
        x = np.array([[r[n] for n in self.names] for r in rows], float)
        rules = boosted_rules(x, y, self.names, k)
        if not rules:
            mean = np.average(y, weights=k)
            self.intercept = float(np.log(mean / (1 - mean)))
            return
        full = {n: x[:, k] for k, n in enumerate(self.names)}
        r = np.array([rule.holds(full) for rule in rules]).T.astype(float)
        check = np.arange(len(y)) % 5 == 0  # rows in order of doc_id
        best, start = (np.inf, 0.0), None
        for penalty in (0.03, 0.01, 0.005, 0.002, 0.001):
            start = lasso(r[~check], y[~check], penalty, start, weights=k[~check])
            p = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(check.sum()), r[check]] @ start, -30, 30)))
            loss = -np.average(np.log(np.where(y[check] == 1, p, 1 - p) + 1e-9), weights=k[check])
            best = min(best, (loss, penalty))
        w = lasso(r, y, best[1], steps=600, weights=k)
        self.intercept = float(w[0])
        self.rules = [(rule, float(k)) for rule, k in zip(rules, w[1:], strict=True) if abs(k) > 1e-6]

    def column(self, x: dict[str, Column]) -> Column:
        """The score as one expression over the statistics columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(x), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; ``predicted`` is 1 from a score of THRESHOLD.

    Null texts score like empty ones; repeated rows score alike; a null doc_id is scored and not held out.  Only ``text`` is an input
    of a score.
    """
    model = Quality(documents, labels)
    stats = statistics(F.col("text"))
    used = {name for rule, _ in model.rules for name, _, _ in rule.conditions}
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in stats.items() if n in used])
    scored = base.select("doc_id", model.column({n: F.col(n) for n in used}).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
