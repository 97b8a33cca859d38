"""Planning of single questions."""

import json

from quillscreen.plans import planner
from quillscreen.plans.contract import Contract, Group


def test_seed_hints():
    q = 'Compare "Surface Magnetism and the Modern Theory of Order" with Deep Learning Methods For Screening: A Review of Tools, doi 10.1000/ABC.5). and arXiv:2001.00001v2, again 10.1000/abc.5'
    got = [(h.kind, h.value) for h in planner.seed_hints(q)]
    assert ("title", "Surface Magnetism and the Modern Theory of Order") in got and ("arxiv", "2001.00001v2") in got
    assert sum(k == "doi" for k, _ in got) == 1 and any(v.startswith("Deep Learning Methods For Screening: A Review") for _, v in got)
    assert planner.seed_hints("") == [] and planner.seed_hints('a "plain short quote" only') == []


def test_route():
    packs = [planner.Pack("a", (("spin",), ("oxide",)), (("clinical",),), 2), planner.Pack("b", (("oxide",),))]
    assert planner.route("spin of an oxide", packs)[0] == "a" and planner.route("an oxide", packs) == ("b", 0.95)
    assert planner.route("clinical spin oxide", packs)[0] == "b" and planner.route("soup", packs) == (planner.FALLBACK, 0.35)


def test_packs_and_queries(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"name": "x", "positive_groups": [["cat"]], "min_positive_groups": 1}))
    assert planner.load_packs(spark, str(tmp_path))[0].positive == (("cat",),)
    c = Contract("q", groups=(Group("core", ("spin state", "OER")), Group("ctx", ("oxide",)), Group("opt", ("XPS",), required=False)))
    assert planner.provider_queries(c, "openalex") == ['("spin state" OR OER) AND (oxide)', '("spin state" OR OER) AND (oxide) AND (XPS)']
    assert planner.planned_queries(spark, [c]).count() == 4
