"""Run diagnostics on small tables with ties, blanks, nulls and repeats."""

from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators import diagnostics as dg
from quillscreen.sources import providers


def test_patterns_need_boundaries_only_when_short(spark):
    d = spark.createDataFrame([(1, "A <b>thin</b>–film of MoS2; MOF"), (2, "mofs and thin film"), (3, None), (4, "thin-&amp;film")], "i int, t string")
    got = {r.i: r.m for r in dg.matched_patterns(d, "t", ("thin-film", "mof", "MOF"), "m").collect()}
    assert got == {1: ["mof"], 2: ["thin-film"], 3: [], 4: []}


def test_stop_rule_keeps_the_attempt_that_stops(spark):
    rows = [("a", 1, 200, ""), ("a", 2, 429, "Rate limit reached"), ("a", 3, 200, ""), ("b", 1, 429, "slow down"), ("b", 2, 500, "too many requests"), ("b", 3, None, None)]
    got = dg.before_stop(spark.createDataFrame(rows, "provider string, attempt int, status_code int, error string"))
    assert sorted((r.provider, r.attempt) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]


def test_repairs_replace_drop_and_append(spark):
    queries = spark.createDataFrame([("p", "one", 0), ("p", "two", 1), ("p", "three", 2), ("q", "one", 3)], "provider string, query string, ord long")
    repairs = [(0, "p", "one", "repair", "uno"), (1, "p", "two", "drop", ""), (2, "p", "x", "repair", "extra"), (3, "p", "y", "repair", "UNO")]
    got = dg.repaired_queries(queries, spark.createDataFrame(repairs, "ord long, provider string, original_query string, recommendation string, repaired_query string"))
    assert sorted((r.provider, r.pos, r.query) for r in got.collect()) == [("p", 1, "uno"), ("p", 2, "three"), ("p", 3, "extra"), ("q", 1, "one")]


def test_next_searches_are_distinct_without_case(spark):
    one = lambda rows: spark.createDataFrame(rows, "ord long, suggestion string")
    got = dg.next_searches([one([(2, "b"), (1, " A  x ")]), one([(0, "a X"), (1, None), (2, "c"), (3, "")])], 2)
    assert [(r.pos, r.suggestion) for r in got.collect()] == [(1, "A x"), (2, "b")]


def test_last_paper_and_kept_edges(spark):
    p = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], "paper_id string, input_ord long, v string")
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "paper_id string")
    assert [tuple(r) for r in dg.last_by_id(p, ids).collect()] == [("a", 3, None)]
    edges = spark.createDataFrame([("s", "a"), ("s", "q"), ("s", "a")], "src_paper_id string, dst_paper_id string")
    assert dg.kept_edges(edges, p).count() == 2


def test_answers_are_parsed_safely(spark):
    rows = [(1, '```json\n{"a": 1}\n```'), (2, ' {"a": [2]} '), (3, "[1]"), (4, "{broken"), (5, None), (6, "```\n{}\n```")]
    got = {r.i: r.error_type for r in dg.parsed_answer(spark.createDataFrame(rows, "i int, t string"), "t").select("i", "error_type").collect()}
    assert got == {1: "", 2: "", 3: "json_not_object", 4: "invalid_json", 5: "invalid_json", 6: ""}


def test_provider_rates(spark):
    d = spark.createDataFrame([("success",), ("failed",), ("odd",), ("",), (None,)], "status string")
    r = dg.provider_rates(d).first()
    assert r.provider_success_rate == 0.4 and r.provider_error_count == 1
    assert tuple(dg.provider_rates(d.limit(0)).first()) == (None, None)


def test_query_quality_without_queries(spark):
    d = spark.createDataFrame([], "query string")
    r = dg.query_quality(d, "query", (), {"a": ("x",)}).first()
    assert (r.n_queries, r.n_bad, r.query_quality_score) == (0, 0, 0.4)


def test_lanes_of_the_first_papers(spark):
    rows = [("q", 1, "a", "seed", 0.0), ("q", 2, "b", "keyword", 0.05), ("q", 3, "c", "keyword", 0.0), ("q", 4, "d", "keyword", 0.1)]
    got = dg.lane_diagnostics(spark.createDataFrame(rows, "question_id string, rank int, paper_id string, lane string, false_positive_penalty double"), 3)
    assert {r.lane: (r.n_papers, r.n_penalised, r.paper_ids) for r in got.collect()} == {"seed": (1, 0, ["a"]), "keyword": (2, 1, ["b", "c"])}


def test_inverted_index_keeps_the_last_word_of_a_position(spark):
    d = spark.createDataFrame([({"b": [1], "a": [0, 3], "c": [1]},), ({},), (None,)], "m map<string,array<int>>")
    assert [r.t for r in d.select(providers.abstract_of(F.col("m")).alias("t")).collect()] == ["a c a", "", ""]


def test_spellings_and_plurals():
    assert sorted(tx.variants("Li-ion battery")) == sorted(["li-ion battery", "li ion battery", "li-ion-battery", "li-ion batteries", "li-ionbattery"])
    assert tx.py_folded("batteries dies gas glass cats") == ["batteries", "battery", "cat", "cats", "die", "dies", "gas", "glas", "glass"]
    assert tx.forms("battery") == ["battery", "batteries", "batterys"] and tx.forms("die") == ["die", "dies"] and "movies" not in tx.forms("movie")


def test_first_sentence_is_that_of_all(spark):
    texts = ["One. Two!", " a?b c. ", "none", "", None, "x.  \n y", "end."]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = d.select(tx.first_sentence("t").alias("a"), F.coalesce(F.get(tx.sentences("t"), F.lit(0)), F.lit("")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
