"""What workers find in batches of texts equals the expressions, and no token arrays are built for it."""

import random

from pyspark.sql import functions as F

from quillscreen.functions import matcher
from quillscreen.functions import similarity as sim
from quillscreen.functions import text as tx
from quillscreen.functions.best import best_sentence
from quillscreen.operators import reading
from quillscreen.operators.guardrail import Spellings
from quillscreen.plans import papers as pp
from quillscreen.plans import screening

ODD = [
    "a- b &lt;sub&gt;2 x</ SUB > the that‐the  que la\t und \n die", "é_the of the.The der? DER!  ", "İstanbul ΣΣ und die. that theΣ there", "", "   ", ". . .",
    "²the thé2 ́la that-this <i>of the</i> not  there absent", None, "a. b the! que el", "KK in ſub. <ſub>x", "the thethe that this",
]
TERMS = ("the", "that this", "que el", "2024", "of", "", "und die", "la")


def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, t string").coalesce(1)


def test_needles_equal_the_token_arrays(spark):
    d = texts(spark).withColumns({"low": F.lower(tx.text("t")), "tok": tx.tokens("t")})
    there = matcher.Present("p")
    own = [there.has_term(t).alias(f"a{i}") for i, t in enumerate(TERMS)] + [there.has_tokens(t).alias(f"b{i}") for i, t in enumerate(TERMS)]
    want = [tx.has_term(F.col("low"), F.col("tok"), t) for t in TERMS] + [tx.has_tokens(F.col("tok"), t) for t in TERMS]
    d = d.withColumn("p", there.column(F.col("low")))
    assert [tuple(r) for r in d.orderBy("i").select(*own).collect()] == [tuple(r) for r in d.orderBy("i").select(*want).collect()]


def test_best_sentence_of_a_batch_equals_the_expressions(spark):
    d = texts(spark).withColumns({"s": tx.sentences("t"), "b": best_sentence(F.col("t"), pp.QUESTION)})
    best = F.array_max(F.transform("s", lambda x, i: F.struct(tx.overlap(tx.runs(x), pp.QUESTION).alias("ov"), (-i).alias("neg"), x.alias("s"))))
    words = len(set(tx.py_tokens(pp.QUESTION)))
    for r in d.withColumn("e", best).collect():
        assert r.b.n == len(r.s) and r.b.sentence == (r.e.s if r.e else None)
        assert (r.b.at, r.b.hits) == ((-r.e.neg, round(r.e.ov * words)) if r.e else (None, None))


def test_comparable_equals_the_expression(spark):
    for r in texts(spark).select("t", tx.domain_text("t").alias("x")).collect():
        assert matcher.comparable(r.t or "") == r.x


def test_stop_words_are_dropped_while_counting(spark):
    d = spark.createDataFrame([(["the", "a", "b", "a"],), (["the"],), ([],)], "w array<string>").coalesce(1)
    got = [r.s for r in d.select(sim.word_stats(F.col("w"), ["a", "zz"], ["the"]).alias("s")).collect()]
    assert [(s.squares, list(s.counts)) for s in got] == [(5.0, [2, 0]), (0.0, [0, 0]), (0.0, [0, 0])]


def test_no_array_of_all_tokens_is_built_to_look_for_terms(spark):
    papers = pp.papers(spark, "/root/testdata/sf0.001")
    plan = screening.assess(screening.classified(papers, pp.ROLE_RULES), pp.CONTRACT, pp.NOW_YEAR)._jdf.queryExecution().optimizedPlan().toString()
    assert ", [a-z0-9]{2,}+" not in plan


def test_word_counts_of_texts_equal_those_of_word_arrays(spark):
    """Texts of all kinds, alone and together, with characters that the worker's own class of words takes for others."""
    more = ["x² ½ 1º ªa é è éé", "a\u0301b c\u200dd Ⓐⓑ 中文 文 “quoted” – dash—es 𝒳𝒴 😀ab a_b __", "The the THE that THAT's 42 4"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, *more])], "i long, t string").coalesce(1)
    d = d.withColumns({"a": F.lower(tx.text("t")), "b": F.lower(F.concat_ws(" ", tx.text("t"), F.lit("that é Other")))})
    wanted, stop = ["that", "é", "éé", "zz", "the", "中文", "42"], ["the", "of"]
    d = d.withColumn("s", sim.text_stats([F.col("a"), F.col("b")], [[0], [1], [0, 1]], wanted, stop))
    for c, words in (("w0", sim.words_of(F.col("a"))), ("w1", sim.words_of(F.col("b"))), ("w2", F.concat(sim.words_of(F.col("a")), sim.words_of(F.col("b"))))):
        d = d.withColumn(c, words)
    for k in range(3):
        d = d.withColumn(f"e{k}", sim.word_stats(F.col(f"w{k}"), wanted, stop))
    for r in d.collect():
        for k in range(3):
            assert (r.s[k].squares, list(r.s[k].counts)) == (r[f"e{k}"].squares, list(r[f"e{k}"].counts)), (r.t, k)


def test_concepts_held_equal_the_expressions(spark):
    rng = random.Random(5)
    words = ["not ", "no ", "of the ", "of-the ", "the", "solid oxide", "solid ", "oxides ", "batteries ", "battery ", "lithium ", "lithium-ion ", " absent", " not studied", "x" * 20, ". "]
    values = [None, *ODD, *("".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(300))]
    terms = ["of the", "solid oxide", "oxide", "lithium battery", "lithium-ion batteries", "battery", "x", "", "that the", "la"]
    d = spark.createDataFrame([(v,) for v in values], "t string").coalesce(2).withColumn("x_raw", tx.text("t"))
    spelled = Spellings("x")
    got = {f"g{i}": spelled.concept(t) for i, t in enumerate(terms)}
    d = d.withColumns({"x": tx.domain_text("t"), "x_s": spelled.column()}).withColumn("tok", tx.tokens("x"))
    d = d.withColumns(got | {f"w{i}": tx.has_concept(F.col("x"), F.col("tok"), t) for i, t in enumerate(terms)})
    rows = d.collect()
    for r in rows:
        assert [r[f"g{i}"] for i in range(len(terms))] == [r[f"w{i}"] for i in range(len(terms))], r.t
    assert all(any(r[f"g{i}"] for r in rows) for i, t in enumerate(terms) if len(t) > 1)


def test_no_array_of_all_words_is_a_column_of_the_assessment(spark):
    papers = pp.papers(spark, "/root/testdata/sf0.001")
    plan = screening.assess(screening.classified(papers, pp.ROLE_RULES), pp.CONTRACT, pp.NOW_YEAR)._jdf.queryExecution().optimizedPlan().toString()
    assert "{2,}+" not in plan


def test_keywords_leave_stop_words_out_after_counting(spark):
    d = spark.createDataFrame([("include", "The of oxide a", "oxide THE film x1"), ("exclude", "oxide", "film"), ("include", None, "to b film")], "decision string, title string, abstract string")
    found = reading.keywords(d)
    assert [tuple(r) for r in found.collect()] == [("film", 2), ("oxide", 2), ("x1", 1)]
    assert "(?<!" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_value_counts_compute_their_column_once(spark):
    d = spark.createDataFrame([("a b",), (" ",), (None,), ("b",)], "t string").select(F.split("t", " ").alias("v"))
    found = reading.value_counts(d, "v")
    assert [tuple(r) for r in found.collect()] == [("b", 2), ("a", 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
