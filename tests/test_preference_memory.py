"""The vocabulary of the preference classifier comes from an aggregate, and no gram is kept in memory."""

from quillscreen.operators import preference


def test_no_grams_are_kept_in_memory(spark):
    rows = [(f"p{i}", ("good solid work " if i % 2 else "poor weak claim ") + f"word{i} other{i}") for i in range(12)]
    texts = spark.createDataFrame(rows, "paper_id string, text string")
    labels = spark.createDataFrame([(f"p{i}", "include" if i % 2 else "exclude") for i in range(8)], "paper_id string, label string")
    before = set(spark.sparkContext._jsc.getPersistentRDDs().keySet().toArray())
    d = spark.createDataFrame([(["b", "a", "b"],), (["c", "a"],), ([],)], "grams array<string>")
    assert preference.frequent(d, 2) == ["a", "b"] and preference.frequent(d.limit(0)) == []
    got = {r.paper_id: r.preference_score for r in preference.classifier_scores(texts, labels).collect()}
    assert len(got) == 12 and all((got[f"p{i}"] > 0.5) == bool(i % 2) for i in range(12))
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet().toArray()) <= before
