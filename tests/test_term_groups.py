"""Groups of aliases against all pairs and a plain union, and the groups of a frame."""

import random

from quillscreen.operators import term_groups as tg
from quillscreen.operators.anchors import Frame

RNG = random.Random(6)


def plain_groups(terms):
    """Term to smallest term of its component, by looking at all pairs."""
    every = sorted({tg.cleaned(t) for t in terms if t and t.strip()})
    label = {t: t for t in every}

    def root(t):
        while label[t] != t:
            t = label[t]
        return t

    for a in every:
        for b in every:
            if tg.aliases(a, b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {t: root(t) for t in every}


def test_groups_equal_all_pairs(spark):
    words = ["ion", "anode", "solid", "electrolyte", "phase", "x-ray", "ald", "layer", "deposition", "atomic", "se", "ie"]
    terms = [" ".join(RNG.choice(words) for _ in range(RNG.randint(1, 3))) for _ in range(60)] + ["SEP", "solid electrolyte phase", "  Solid   Electrolyte ", "ald", None, "", " ", "x", "unrelated qqq", "ald", "xr", "q" * 300, "x-ray " + "q" * 300]
    d = spark.createDataFrame([(t, i % 9 == 0, "clash") for i, t in enumerate(terms)], "term string, must boolean, label string").repartition(3)
    want = plain_groups([t for t in terms if t and len(t) <= tg.LONGEST]) | {"q" * 300: "q" * 300, "x-ray " + "q" * 300: "x-ray " + "q" * 300}
    got = {r.term: r for r in tg.alias_groups(d, "term", "must").collect()}
    assert {t: r.label for t, r in got.items()} == want
    must = {tg.cleaned(t) for i, t in enumerate(terms) if i % 9 == 0 and t and t.strip()}
    for t, r in got.items():
        assert r.required == (t in must) and r.group_required == any(u in must for u in want if want[u] == want[t])
    assert tg.alias_groups(d.limit(0)).collect() == []


def test_a_long_chain_settles(spark):
    chain = ["abcdefghijklmnopqrstuvwxyz"[i : i + 3] for i in range(24)] + ["abcdefghijklmnopqrstuvwxyz"[i : i + 4] for i in range(23)]
    d = spark.createDataFrame([(t,) for t in chain], "term string")
    assert {r.label for r in tg.alias_groups(d).collect()} == {"abc"}


def test_groups_of_a_frame():
    frame = Frame(
        research_object=("solid electrolyte interphase", "SEI", "graphite anode", "anode"), domain_context=("interface", "lithium-ion battery"), target_process_or_property=("SEI growth", "SEI composition", "other thing"), method_terms=("XPS", "review"),
        downweighted_terms=("Review",),
    )
    groups = {g.name: g for g in tg.groups_of(frame, "How does the SEI on lithium anodes grow?")}
    assert groups["core_object_group_1"].terms == ("solid electrolyte interphase", "SEI", "SEI growth") and groups["core_object_group_2"].terms == ("graphite anode", "anode")
    assert groups["domain_context_group"].terms == ("lithium-ion battery",) and groups["domain_context_group"].required
    assert groups["method_group"].terms == ("XPS",) and not groups["method_group"].required and groups["target_chemistry_group"].required and not groups["negative_context_group"].required
    single = tg.groups_of(Frame(core_terms=("SEI",), target_process_or_property=("SEI growth",), domain_context=("surface",)))
    assert [(g.name, g.terms) for g in single] == [("core_object_group", ("SEI", "SEI growth")), ("domain_context_group", ("surface",)), ("process_or_property_group", ("SEI growth",))]
    assert tg.groups_of(Frame()) == [] and not tg.aliases("", "x") and tg.aliases("ALD", "atomic layer-deposition")
