"""Deduplication where doc_ids are null, or shared by unrelated texts."""

from geoweave.llm import minhash


def copies(name, n):
    """Texts of 400 words that differ from each other in two words."""
    return [" ".join(f"{name}{i}" if i != 60 * k + 30 else f"other{k}" for i in range(400)) for k in range(n)]


def test_groups_are_components_not_doc_ids(spark):
    one, two = copies("a", 2), copies("b", 2)
    docs = spark.createDataFrame([(5, one[0]), (6, one[1]), (5, two[0]), (7, two[1])], "doc_id long, text string")
    assert sorted(r.text for r in minhash.deduplicate(docs, 80).collect()) == sorted([one[0], two[0]])


def test_near_copies_without_any_id_leave_one(spark):
    one, two = copies("a", 3), copies("b", 3)
    docs = spark.createDataFrame([(None, t) for t in one + two] + [(None, one[0]), (None, None)], "doc_id long, text string")
    kept = [r.text for r in minhash.deduplicate(docs, 80).collect()]
    assert len(kept) == 3 and None in kept
    assert sum(t in one for t in kept) == 1 and sum(t in two for t in kept) == 1
