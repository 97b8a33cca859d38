"""Term search, glossaries and the query gate against plain versions, with nulls, blanks, ties, repeats and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillscreen.functions import matcher
from quillscreen.functions import text as tx
from quillscreen.operators import anchors, glossary
from quillscreen.plans import glossaries
from quillscreen.plans.contract import Group

RNG = random.Random(11)


def texts(spark, values):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in enumerate(values)], "id long, text string, term string, start string").repartition(2)


def rows(d, col):
    return {r["id"]: r[col] for r in d.collect()}


def test_hits_and_longest_equal_plain_search(spark):
    terms = ["a", "ab", "aba", "bab", "abab", "b a", "", " ", "ab", "é日"]
    values = [None, "", *("".join(RNG.choice("ab é日") for _ in range(RNG.randint(0, 30))) for _ in range(150)), "ab" * 5000]
    d = texts(spark, values)
    got = rows(d.select("id", matcher.hits(F.col("text"), terms).alias("h"), matcher.first_hits(F.col("text"), terms).alias("f"), matcher.longest(F.col("text"), terms).alias("l")), "h"), None
    all_hits = got[0]
    for i, v in enumerate(values):
        v = v or ""
        want = sorted((p, n) for n, t in enumerate(terms) if t.strip() for p in range(len(v) - len(t) + 1) if v.startswith(t, p))
        assert [(h.start, h.term) for h in all_hits[i]] == want
    first, longest = (rows(d.select("id", f(F.col("text"), terms).alias("h")), "h") for f in (matcher.first_hits, matcher.longest))
    for i, v in enumerate(values[:-1]):
        v = v or ""
        assert [(h.term, h.start) for h in first[i]] == [(n, v.find(t)) for n, t in enumerate(terms) if t.strip() and t in v]
        at, want = 0, []
        while at < len(v):
            best = max((t for t in terms if t.strip() and v.startswith(t, at)), key=len, default="")
            if best:
                want.append((terms.index(best), at))
            at += len(best) or 1
        assert [(h.term, h.start) for h in longest[i]] == want


def test_searches_for_nothing(spark):
    d = texts(spark, ["some text", None])
    for f in (matcher.hits, matcher.first_hits, matcher.longest, matcher.longest_first):
        assert set(map(tuple, rows(d.select("id", f(F.col("text"), ["", " "]).alias("h")), "h").values())) == {()}
    assert rows(d.limit(0).select("id", matcher.hits(F.col("text"), ["a"]).alias("h")), "h") == {}


def test_standing_equals_the_expressions(spark):
    """Negation around hits, against one look-around expression per needle."""
    words = ["not ", "no ", "without ", "sei", "oxide ", " absent", " not studied", "x" * 20, "sei film", " "]
    values = [None, *("".join(RNG.choice(words) for _ in range(RNG.randint(0, 9))) for _ in range(300))]
    needles = ["sei", "oxide", "sei film", "absent"]
    d = texts(spark, values).withColumn("s", matcher.standing(F.col("text"), needles))
    each = [F.coalesce(F.col("text"), F.lit("")).contains(n).alias(f"f{i}") for i, n in enumerate(needles)] + [tx.stands(F.coalesce(F.col("text"), F.lit("")), n).alias(f"c{i}") for i, n in enumerate(needles)]
    for r in d.select("s", tx.tokens("text").alias("t"), *each).collect():
        assert r.s.found == [i for i in range(4) if r[f"f{i}"]] and r.s.clear == [i for i in range(4) if r[f"c{i}"]] and {needles[i] for i in r.s.words} - {"sei film"} == {"sei", "oxide", "absent"} & set(r.t)


# ---- glossary


def plain_glossary(text, translations, expansions):
    """Entry by entry, the longest first, over explicit ranges."""
    found, ranges = [], []
    for source in sorted(translations, key=len, reverse=True):
        at = text.find(source)
        while at >= 0:
            if not any(a <= at and at + len(source) <= b for a, b in ranges):
                ranges.append((at, at + len(source)))
                found += glossary.targets(translations[source])
                break
            at = text.find(source, at + len(source))
    for phrase, target in expansions.items():
        if phrase in text:
            found += glossary.targets(target)
    return tx.unique(found, 32)


def test_glossary_terms(spark):
    pieces = [*glossaries.TRANSLATIONS, *glossaries.EXPANSIONS, "电", "态", " ", "的", "LLMs"]
    values = [None, "", *("".join(RNG.choice(pieces) for _ in range(RNG.randint(1, 40))) for _ in range(200)), "锂离子电池的界面电池"]
    got = rows(glossary.glossary_terms(texts(spark, values), "text", glossaries.TRANSLATIONS, glossaries.EXPANSIONS, "out"), "out")
    for i, v in enumerate(values):
        assert got[i] == plain_glossary(v or "", glossaries.TRANSLATIONS, glossaries.EXPANSIONS), v
    assert got[len(values) - 1] == ["lithium-ion battery", "battery", "interface"]
    repeats = {"aa": "x", "aaa": "y; x | Z", "b": " ; "}
    values = ["a" * n + "b" * (n % 2) for n in range(12)]
    got = rows(glossary.glossary_terms(texts(spark, values), "text", repeats, {}, "out"), "out")
    assert [got[i] for i in range(12)] == [plain_glossary(v, repeats, {}) for v in values]


def test_query_seed(spark):
    values = ["反铁磁材料的表面磁化 in Cr2O3", "大语言模型", "spin Spin of the 自旋", "   ", None, "。。", "LLM agents for 文献 筛选 LLM"]
    got = rows(glossary.query_seed(texts(spark, values), "text", glossaries.TOPICS), "seed")
    assert got[0] == "surface magnetization antiferromagnetic ferromagnetic materials in cr2o3"
    # The longer entry holds the shorter one, whose tokens are known by then.
    assert got[1] == "large language model" and got[2] == "spin of the" or got[2].startswith("spin")
    assert got[3] == got[4] == got[5] == glossary.NO_SEED
    assert got[6].split()[:2] == ["literature", "screening"] and got[6].endswith("llm agents for")


# ---- anchors and the gate

FRAME = anchors.Frame(
    research_object=("solid electrolyte interphase", "failure mechanism", "SEI"), core_terms=("Graphite anode", "graphite  ANODE", "review"), domain_context=("lithium-ion battery", "sei"), method_terms=("XPS", "in situ Raman measurement cell"),
    mechanism_terms=("growth",), relation_or_effect=("importance", "capacity fade"),
)
GROUPS = (Group("battery_context", ("lithium", "background")), Group("empty_context", ("review",)), Group("core", ("zzz",)), Group("side_process", ("zzz",), required=False))


def plain_hits(query, term):
    """(any, full) of one query and term by token sets."""
    low, t = anchors.plain(query), anchors.plain(term)
    mine, its = set(tx.py_tokens(low)), set(tx.py_tokens(t))
    full = bool(t) and (t in low or (bool(its) and its <= mine))
    return full or (len(its) > 2 and len(its & mine) >= 2), full


def test_frame_and_groups():
    a = FRAME.anchors()
    assert a[anchors.CORE] == ["solid electrolyte interphase", "SEI", "Graphite anode"] and a[anchors.SECONDARY] == ["lithium-ion battery"]
    assert a[anchors.NEED] == ["XPS", "in situ Raman measurement cell", "growth", "capacity fade"]
    assert anchors.required_anchor_groups(GROUPS) == [("battery_context", ["lithium"])]
    assert anchors.is_need("Failure mechanism") and anchors.is_need("charge measurement") and not anchors.is_need("reaction mechanism")


def test_anchor_hits_equal_token_sets(spark):
    terms = ["solid electrolyte interphase", "SEI", "in situ raman cell", "of the", "ei", "", "+(", "raman"]
    words = ["solid", "electrolyte", "interphase", "sei", "situ", "raman", "cell", "of", "the", "seismic", "(", "+", '"']
    values = sorted({anchors.plain(" ".join(RNG.choice(words) for _ in range(RNG.randint(0, 8)))) for _ in range(200)})
    found = {(r.key, r.anchor): r for r in anchors.anchor_hits(texts(spark, values).select("text"), terms).collect()}
    for v in values:
        for i, t in enumerate(terms):
            any_, full = plain_hits(v, t)
            r = found.get((hashlib.md5(v.encode()).hexdigest(), i))
            assert (r is not None) == any_ and (r is None or r.full == full), (v, t)
            if r is not None and r.shared:
                assert r.shared == len(set(tx.py_tokens(v)) & set(tx.py_tokens(t)))


def test_tasks_that_count_pairs_grow_in_number_not_in_size(spark, monkeypatch):
    terms = ["solid oxide film", "oxide", "film cell", "so"]
    values = [f"solid oxide film {i}" for i in range(200)] * 2 + ["", None, "cell film", "nothing"]
    want = sorted(anchors.anchor_hits(texts(spark, values).select("text"), terms).collect())
    monkeypatch.setattr(anchors, "TOKENS", 50)
    found = anchors.anchor_hits(texts(spark, values).select("text"), terms)
    # 200 texts of three tokens and three hits at least, at 50 for each task.
    assert found.rdd.getNumPartitions() >= 20 and sorted(found.collect()) == want
    assert len(want) == 200 * 3 + 1


def test_gate_outcomes_in_order(spark):
    cases = [
        ("", "x", "empty_query"), (None, "seed_context", "empty_query"), ("anything at all", "seed_context", "seed_context"), ('"SEI"', None, "single_acronym_only_query"), ("graphite OR", "", "single_acronym_only_query"),
        ("graphite anode films", "p", "missing_required_context_or_process_anchor"), ("lithium growth rates", "p", "method_or_need_only_query"), ("lithium metal plating", "p", "missing_core_object_anchor"),
        ("SEI on lithium", "p", "missing_context_or_process_anchor"), ("SEI in lithium-ion battery", "p", "anchor_rule_passed"), ("solid interphase lithium ion", "p", "anchor_rule_passed"), ("SEI in lithium-ion battery", "p", "anchor_rule_passed"),
    ]
    d = spark.createDataFrame([(None if i == 3 else i, q, s, "clash") for i, (q, s, _) in enumerate(cases)], "id long, query string, source string, text string")
    got = anchors.gate(d, FRAME, GROUPS).collect()
    assert sorted((str(r.query), r.reason) for r in got) == sorted((str(q), want) for q, _, want in cases)
    assert all(r.keep == (r.reason in ("seed_context", "anchor_rule_passed")) for r in got)
    assert [r.missing_groups for r in got if r.query == "graphite anode films"] == [["battery_context"]] and {r.text for r in got} == {"clash"}
    assert anchors.gate(d.limit(0), FRAME, GROUPS).collect() == []
    bare = {r.reason for r in anchors.gate(d, None).collect()}
    assert bare == {"empty_query", "seed_context", "single_acronym_only_query", "no_generic_frame_available"}


def test_gate_without_context(spark):
    frame = anchors.Frame(research_object=("films", "co2 uptake"), method_terms=("sputtering",))
    d = spark.createDataFrame([(q, "p") for q in ("films on steel", "films by sputtering", "films co2 uptake rates", "steel plates", "films for co2 uptake")], "query string, source string")
    got = {r.query: r.reason for r in anchors.gate(d, anchors.Frame(research_object=("films", "co2 uptake"), relation_or_effect=("sputtered",))).collect()}
    assert got == {"films on steel": "missing_second_anchor", "films by sputtering": "missing_second_anchor", "films co2 uptake rates": "anchor_rule_passed", "steel plates": "missing_core_object_anchor", "films for co2 uptake": "anchor_rule_passed"}
    # A topic of thin films has a critic of its own, which comes first.
    assert {r.query: r.critic_issue for r in anchors.gate(d, frame).collect()}["films by sputtering"] == "overbroad_queries:thin_film_single_method_query"


@pytest.mark.parametrize(
    ("query", "generator", "critic", "tool"),
    [("SEI", True, True, True), ("sei", True, True, True), ("review", False, False, False), ("REVIEW", True, True, False), ("electrochemistry", False, False, False), ("x", True, False, False), ("sei OR SEI", False, True, False), ('+"MOF"', True, True, True), ("", False, False, False), (None, False, False, False), ("lib AND lib", False, True, False), ("PERFORMANCE-2", False, False, False), ("ABC-DEF-9", True, False, False)],
)
def test_acronym_tests_differ(spark, query, generator, critic, tool):
    r = spark.createDataFrame([(query,)], "q string").select(anchors.lone_word("q").alias("a"), anchors.lone_acronym("q").alias("b"), anchors.listed_acronym("q").alias("c")).first()
    assert (r.a, r.b, r.c) == (generator, critic, tool)
