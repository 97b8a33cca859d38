"""Ranks from narrow keys, in one window or in blocks, and word counts of a batch."""

from pyspark.sql import functions as F

from quillscreen.functions import similarity as sim
from quillscreen.operators import ranking


def scored(spark, n=400):
    d = spark.range(n).withColumnRenamed("id", "input_ord")
    parts = {c: (F.col("input_ord") * k % 7) / 7.0 for c, k in (("relevance", 3), ("evidence", 5), ("recency", 2), ("quality", 4))}
    d = d.withColumns({"question_id": F.concat(F.lit("q"), F.col("input_ord") % 2), "paper_id": F.concat(F.lit("p"), "input_ord"), "venue": F.when(F.col("input_ord") % 5 == 0, "").otherwise(F.concat(F.lit("v"), F.col("input_ord") % 3)), **parts})
    return d.withColumn("abstract", F.repeat(F.lit("long text "), 100))


def test_ranks_in_blocks_equal_the_window(spark, monkeypatch):
    out = ("question_id", "paper_id", "rank", "diversity", "final0", "final")
    one = sorted(ranking.rank(scored(spark)).select(*out).collect())
    monkeypatch.setattr(ranking, "ALONE", 0)
    assert sorted(ranking.rank(scored(spark)).select(*out).collect()) == one
    assert sorted(r.rank for r in one if r.question_id == "q0") == list(range(1, 201))


def test_no_window_holds_whole_papers(spark):
    plan = ranking.rank(scored(spark))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("abstract" in line for line in plan.split("Window [", 1)[1].splitlines())


def test_word_stats_equal_the_expressions(spark):
    rows = [(["a", "b", "a", "c"],), ([],), (["b"] * 5,), (["é", "a"],)]
    d = spark.createDataFrame(rows, "w array<string>").coalesce(1)
    got = d.select(sim.word_stats(F.col("w"), ["a", "b", "zz"]).alias("s"), sim.square_sum(F.col("w")).alias("q")).collect()
    assert [r.s.squares for r in got] == [r.q for r in got] == [6.0, 0.0, 25.0, 2.0]
    assert [list(r.s.counts) for r in got] == [[2, 1, 0], [0, 0, 0], [0, 5, 0], [1, 0, 0]]
