"""Papers are ranked and decided without their texts, which are stored and shuffled only as far as a query reads them."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillscreen.operators import gaps, ranking, run_metrics
from quillscreen.operators.store import dealt
from quillscreen.plans import screening
from quillscreen.plans.papers import CONTRACT, NOW_YEAR, ROLE_RULES, papers

WORDS = "that the la de que und die nicht of there worthless license thorough eau der gnu general public was 42".split()
SHOWN = ("paper_id", "rank", "final", "seed_boost", "false_positive_penalty", "decision", "primary_reason", "exclusion_reasons", "reading_priority")


def made(spark, path, n=60):
    texts = [". ".join(" ".join(WORDS[(i * 7 + j * j * k) % len(WORDS)] for j in range(3 + i % 9)) for k in range(1, 4)) for i in range(n)] + [None, "", "of the"]
    docs = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return papers(spark, str(path))


def shown(d, *more):
    return sorted(map(str, d.select(*SHOWN, *more).collect()))


def test_decisions_without_texts_equal_those_with_them(spark, tmp_path, monkeypatch):
    p, kept, stored = made(spark, tmp_path), [], ranking.stored
    full = screening.screen_and_decide(p, CONTRACT, NOW_YEAR, role_rules=ROLE_RULES)
    monkeypatch.setattr(ranking, "stored", lambda d: kept.append(set(d.columns)) or stored(d))
    assert shown(screening.screen_and_decide(p, CONTRACT, NOW_YEAR, role_rules=ROLE_RULES, texts=())) == shown(full)
    some = screening.screen_and_decide(p, CONTRACT, NOW_YEAR, role_rules=ROLE_RULES, texts=("title", "claim"))
    assert shown(some, "title", "claim") == shown(full, "title", "claim")
    assert [k & set(screening.LONG) for k in kept] == [set(), {"title", "claim"}]
    for what in ("include", "exclude"):
        texts = screening.decided_texts(p, CONTRACT, NOW_YEAR, what, ("title", "abstract"), role_rules=ROLE_RULES)
        assert sorted(texts.select("title", "abstract").collect()) == sorted(full.filter(F.col("decision") == what).select("title", "abstract").collect())


def test_what_is_found_in_texts_beforehand_stands_for_them(spark, tmp_path):
    p = made(spark, tmp_path).withColumns({"rank": F.col("input_ord").cast("int"), "decision": F.lit("include")})
    terms = {"language": ("that the", "que la"), "license": ("public",)}
    early = gaps.supporting_titles(p.withColumn("gap_keys", gaps.mentioned(terms)).drop("title", "abstract"), terms)
    late = sorted(map(str, gaps.supporting_titles(p, terms).collect()))
    assert late and sorted(map(str, early.collect())) == late
    metrics = [m for m in run_metrics.standard_metrics() if m.where == run_metrics.TEXT and m.of in ("all", "include")] + [run_metrics.Metric("blank", where="missing_abstract")]
    d = p.withColumns({"reading_priority": F.lit("optional"), "no_abstract": F.col("abstract") == ""})
    found = run_metrics.marked(d, ("public", "42"), ("title", "abstract")).drop("title", "abstract")
    assert run_metrics.evaluate(found, metrics).collect() == run_metrics.evaluate(d.drop("no_abstract"), metrics, ("public", "42"), ("title", "abstract")).collect()


def test_files_with_row_groups_for_all_cores_are_not_dealt(spark, tmp_path):
    rows = pa.table({"n": list(range(8000)), "t": [f"{i} some text" for i in range(8000)]})
    pq.write_table(rows, f"{tmp_path}/many.parquet", row_group_size=500)
    pq.write_table(rows, f"{tmp_path}/one.parquet", row_group_size=8000)
    own = {"spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        plans = {n: dealt(spark.read.parquet(f"{tmp_path}/{n}.parquet")) for n in ("many", "one")}
        assert all(d.count() == 8000 for d in plans.values())
        assert {n: "Repartition" in d._jdf.queryExecution().optimizedPlan().toString() for n, d in plans.items()} == {"many": False, "one": True}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
