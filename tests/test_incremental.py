"""Screening again after an expansion: equal to a full run, with only new contents assessed."""

import dataclasses
import random

from pyspark.sql import functions as F

from quillscreen.plans import incremental, screening
from quillscreen.plans.papers import CONTRACT, NOW_YEAR, ROLE_RULES, papers

RNG = random.Random(5)
WORDS = "that the la de que und die nicht of there worthless license thorough eau der gnu general public was 42".split()


def make(spark, path, rows):
    docs = [(i, t, RNG.choice(["en", "de", None]), RNG.choice(["a", "b", None]), len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return papers(spark, str(path)).withColumn("score", F.lit("clash"))


def shown(d):
    return sorted((r.paper_id, r.rank, r.decision, r.primary_reason, tuple(r.exclusion_reasons), round(r.final, 9)) for r in d.select("paper_id", "rank", "decision", "primary_reason", "exclusion_reasons", "final").collect())


def test_only_new_contents_are_assessed(spark, tmp_path):
    texts = [(i, ". ".join(" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 9))) for _ in range(3))) for i in range(40)] + [(40, None), (41, ""), (42, "la " * 3000)]
    p = make(spark, tmp_path, texts)
    folder = f"{tmp_path}/assessed"
    first, n = incremental.screen_again(p.filter("input_ord < 20"), CONTRACT, NOW_YEAR, folder, role_rules=ROLE_RULES)
    assert n == 20 and first.count() == 20
    union, n = incremental.screen_again(p, CONTRACT, NOW_YEAR, folder, role_rules=ROLE_RULES)
    assert n == 23
    full = screening.screen_and_decide(p, CONTRACT, NOW_YEAR, role_rules=ROLE_RULES)
    assert shown(union) == shown(full) and set(union.columns) == set(full.columns)
    # Copies under other ids share the assessment of their content; another year is another version.
    copies = p.unionByName(p.withColumns({"paper_id": F.concat(F.lit("copy"), "paper_id"), "input_ord": F.col("input_ord") + 1000}))
    both, n = incremental.screen_again(copies, CONTRACT, NOW_YEAR, folder, role_rules=ROLE_RULES)
    assert n == 0 and shown(both) == shown(screening.screen_and_decide(copies, CONTRACT, NOW_YEAR, role_rules=ROLE_RULES))
    assert incremental.assess_missing(p, CONTRACT, NOW_YEAR + 1, folder, ROLE_RULES)[1] == 43
    assert incremental.version(CONTRACT, 1, ()) != incremental.version(dataclasses.replace(CONTRACT, question="other"), 1, ())


def test_expansion_merges_duplicates_first(spark, tmp_path):
    p = make(spark, tmp_path, [(i, f"Title number {i}. that the la text {i}") for i in range(1, 9)])
    folder = f"{tmp_path}/assessed"
    merged = p.filter("input_ord <= 5").withColumn("doi", F.lit(""))
    incremental.assess_missing(merged, CONTRACT, NOW_YEAR, folder, ROLE_RULES)
    # The same records again, and three new ones.
    found = p.withColumns({"doi": F.lit(""), "input_ord": F.col("input_ord") + 100, "paper_id": F.concat(F.lit("again"), "paper_id")})
    decided, n = incremental.expand(merged, found, CONTRACT, NOW_YEAR, folder, role_rules=ROLE_RULES)
    assert decided.count() == 8 and 3 <= n <= 8


def test_no_papers(spark, tmp_path):
    p = make(spark, tmp_path, [(1, "x")]).limit(0)
    decided, n = incremental.screen_again(p, CONTRACT, NOW_YEAR, f"{tmp_path}/assessed", role_rules=ROLE_RULES)
    assert n == 0 and decided.collect() == []
