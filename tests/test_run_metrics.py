"""Run metrics against plain counting, with nulls, empty sets, empty runs and clashing columns."""

import random

import pytest

from quillscreen.operators import run_metrics as rm

RNG = random.Random(8)
COLUMNS = (
    "question_id string, rank int, title string, abstract string, decision string, reading_priority string, domain_decision string, support_level string, missing_required_group_count int, negative_domain_matches array<string>, peripheral_context_reason string, year int, citation_count int,"
    " required_group_coverage_score double, intent_centrality_score double, topic_focus_score double, aspect_coverage_score double, domain_match_score double, final double, all string"
)


def run(n, question="q"):
    pick = RNG.choice
    return [
        (
            question, i + 1, pick(["zinc-ion cells", "Lithium", None]), pick([None, "", "about ZN and more", "znx"]), pick(["include", " Maybe", "exclude", None]), pick(["must_read", "optional", "read_later", None]), pick(["in_scope", "borderline", "out_of_scope", None]),
            pick(["strict_support", "missing_abstract"]), pick([0, 1, None]), pick([[], ["x"], None]), pick(["", "low_topic_focus", None]), pick([None, 2020]), pick([None, 0, 7]), *[pick([None, 0.0, 0.25, 1.0]) for _ in range(6)], "clash",
        )
        for i in range(n)
    ]


def test_metrics_equal_plain_counting(spark):
    rows = run(70) + run(7, "small") + [(None, None, *run(1)[0][2:])]
    d = spark.createDataFrame(rows, COLUMNS).repartition(4)
    metrics = [*rm.standard_metrics(), *rm.grid()]
    got = {r.question_id: r for r in rm.evaluate(d, metrics, ("zinc ion", "zn")).collect()}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    low = lambda v: (v or "").strip().lower()
    sets = {
        "all": lambda r: True, "must_read": lambda r: low(r["reading_priority"]) == "must_read", "include": lambda r: low(r["decision"]) == "include", "maybe": lambda r: low(r["decision"]) == "maybe",
        "optional": lambda r: "optional" in (low(r["decision"]), low(r["reading_priority"])), "exclude": lambda r: "exclude" in (low(r["decision"]), low(r["reading_priority"]), low(r["domain_decision"])) or low(r["domain_decision"]) == "out_of_scope",
    }
    text = lambda r: f"{r['title'] or ''} {r['abstract'] or ''}".lower()
    holds = {
        "forbidden": lambda r: "zinc-ion" in text(r) or " zn " in text(r), "out_of_scope": lambda r: r["domain_decision"] == "out_of_scope", "borderline": lambda r: r["domain_decision"] == "borderline", "in_scope": lambda r: r["domain_decision"] == "in_scope",
        "missing_abstract": lambda r: not r["abstract"], "supported": lambda r: r["support_level"] == "strict_support", "missing_group": lambda r: (r["missing_required_group_count"] or 0) > 0, "negative_term": lambda r: bool(r["negative_domain_matches"]),
        "peripheral": lambda r: bool(r["peripheral_context_reason"]), "undated": lambda r: r["year"] is None, "uncited": lambda r: not r["citation_count"],
    }
    for question in ("q", "small", None):
        papers = [dict(zip(names, r, strict=True)) for r in rows if r[0] == question]
        for m in metrics:
            at = [p for p in papers if sets[m.of](p) and (m.top is None or (p["rank"] is not None and p["rank"] <= m.top))]
            hit = [p for p in at if m.where is None or holds[m.where](p) != m.but_not]
            value = got[question][m.name]
            if m.measure == rm.COUNT:
                assert value == len(hit), m
            elif m.measure == rm.RANKS:
                assert value == sorted(p["rank"] for p in hit), m
            elif m.measure == rm.SHARE:
                assert value == (pytest.approx(len(hit) / len(at)) if at else None), m
            else:
                known = [p[m.column] for p in at if p[m.column] is not None]
                assert value == (pytest.approx(sum(known) / len(known)) if known else None), m
    assert len(metrics) > 60


def test_one_pass_and_no_patterns(spark, tmp_path):
    spark.createDataFrame(run(30), COLUMNS).write.parquet(f"{tmp_path}/ranked")
    d = spark.read.parquet(f"{tmp_path}/ranked")
    made = rm.evaluate(d, [*rm.standard_metrics(), *rm.grid()], ("zn",))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    bare = rm.evaluate(d, rm.standard_metrics()).first()
    assert bare.forbidden_pattern_top10_count is None and bare.forbidden_pattern_top20_rows is None and bare.must_read_precision_heuristic is None and bare.ranked_count == 30
    rows = {r.metric: r for r in rm.long(made).collect()}
    assert rows["ranked_count"].value == 30 and rows["forbidden_pattern_top10_rows"].listed is not None
    assert rm.evaluate(d.limit(0), rm.standard_metrics(), ("zn",)).collect() == []
    with pytest.raises(ValueError, match="no such set"):
        rm.evaluate(d, [rm.Metric("x", of="nowhere")])
