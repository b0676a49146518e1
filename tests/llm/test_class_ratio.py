"""Scores of the classifiers mean the same whether or not the bounds of their samples bind."""

import random

import pytest

from geoweave.llm import quality, samples, toxicity


@pytest.fixture(scope="module")
def mixed(spark):
    """Documents and labels; one in six is marked by rude words, and every other marked one is toxic."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        marked = i % 6 == 0
        words = [f"w{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}{rng.choice('uvwxyz')}" for _ in range(40)]
        if marked:
            words[10:14] = rng.sample(["vileword", "foulword", "nastyword", "grimword", "meanword"], 4)
        docs.append((i, " ".join(words)))
        labels.append((i, int(not marked or i % 12 == 0), int(marked and i % 12 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_weights_restore_the_class_ratio(mixed):
    docs, labels = mixed
    whole = samples.labelled_sample(docs, labels, "toxic", 3, 1, 10**6, 10**6, 10**6).toPandas()
    some = samples.labelled_sample(docs, labels, "toxic", 3, 1, 40, 60, 10**6).toPandas()
    assert (whole.weight == 1).all() and some.groupby("y").size().tolist() == [60, 40]
    assert some.groupby("y").weight.sum().round(6).tolist() == whole.groupby("y").size().tolist()


def test_toxicity_score_does_not_depend_on_the_bound(mixed, monkeypatch):
    docs, labels = mixed
    free = toxicity.toxicity(docs, labels).toPandas()
    monkeypatch.setattr(toxicity, "ORDINARY", 240)
    bound = toxicity.toxicity(docs, labels).toPandas()
    marked = lambda found: found[found.doc_id % 6 == 0]
    assert abs(marked(free).score.mean() - 0.5) < 0.1 and marked(free).predicted.mean() < 0.1
    assert abs(marked(bound).score.mean() - 0.5) < 0.15 and marked(bound).predicted.mean() < 0.3  # a smaller sample: some noise


def test_quality_score_does_not_depend_on_the_bound(mixed, monkeypatch):
    docs, labels = mixed
    # statistics see no rude words: mark them by digits instead; three in four of the marked documents are good
    docs = docs.selectExpr("doc_id", "if(doc_id % 6 = 0, concat(text, ' 12345678901234567890'), text) AS text")
    labels = labels.selectExpr("doc_id", "int(doc_id % 6 <> 0 OR doc_id % 24 <> 0) AS quality", "toxic")
    free = quality.quality(docs, labels).toPandas()
    monkeypatch.setattr(quality, "GOOD", 240)
    bound = quality.quality(docs, labels).toPandas()
    marked = lambda found: found[found.doc_id % 6 == 0]
    assert abs(marked(free).score.mean() - 0.75) < 0.1
    assert abs(marked(bound).score.mean() - marked(free).score.mean()) < 0.1
