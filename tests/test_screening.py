"""Behaviour of the screening operators on hand-made rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillscreen.functions import scoring as sc
from quillscreen.functions import similarity as sim
from quillscreen.functions import text as tx
from quillscreen.operators import dedup, evidence, guardrail, metrics, preference, ranking, roles
from quillscreen.plans.contract import Contract, Group
from quillscreen.sources import importers, providers, sinks
from quillscreen.streaming import events

PAPER = "input_ord long, paper_id string, title string, abstract string, authors array<string>, year int, venue string, doi string, url string, citation_count int, source_provider string"


def paper(o, title="", doi="", abstract="", year=None, venue="", cites=0, authors=()):
    return (o, f"p{o}", title, abstract, list(authors), year, venue, doi, "", cites, "openalex" if o % 2 else "crossref")


def one(spark, column, *values):
    d = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return d.select(column.alias("x")).first().x


def test_keys_and_years(spark):
    assert one(spark, tx.doi_key("c0"), " HTTPS://dx.doi.org/10.1/AB. ") == "10.1/ab" == one(spark, tx.doi_key("c0"), "doi: 10.1/ab")
    assert one(spark, tx.title_key("c0"), " A  Title: of–things! ") == "a title of–things"
    assert one(spark, tx.first_year("c0"), "in19995") == 1999 and one(spark, tx.first_year("c0"), "1750") is None
    assert one(spark, tx.people("c0"), "A B and  C D") == ["A B", "C D"] and one(spark, tx.people("c0"), "A; B;") == ["A", "B"]
    assert one(spark, tx.to_int("c0"), "12.9") == 12 and one(spark, tx.to_int("c0"), "x") == 0
    assert one(spark, tx.tokens("c0"), "The Cat, a 7 x9!") == ["cat", "x9"]


def test_concepts_with_negation_and_variants(spark):
    def has(text, concept):
        d = spark.createDataFrame([(text,)], "x string").select(tx.domain_text("x").alias("x"))
        return d.select(tx.has_concept(F.col("x"), tx.tokens("x"), concept).alias("h")).first().h

    assert has("solid-electrolyte films", "solid electrolyte") and has("Lithium batteries age", "lithium battery")
    assert not has("without lithium metal at all", "lithium metal") and not has("lithium metal is absent", "lithium metal")
    assert has("without lithium metal; then, after a very long pause indeed, lithium metal", "lithium metal")
    assert has("batteries of solid metals", "metal battery") and not has("nothing", "metal")
    assert has("Co<sub>3</sub>O<sub>4</sub> films", "co3o4")


def test_negation_agrees_with_a_direct_search(spark):
    import random

    rng = random.Random(2)
    bits = ["cat ", "not ", "no ", "x", "lack of ", " absent", " not studied", "without ", "dog", "yyyyyyyyyyyy"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000)]

    def direct(t):
        at = [m.start() for m in re.finditer("cat", t)]
        bad = lambda s: any(m in t[max(0, s - 28) : s] for m in tx.NEGATED_BEFORE) or any(m in t[s + 3 : s + 39] for m in tx.NEGATED_AFTER)
        return bool(at) and all(map(bad, at))

    d = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r.n for r in d.select(tx.all_negated(F.col("x"), "cat").alias("n")).collect()] == [direct(t) for t in texts]


def test_markers(spark):
    assert one(spark, tx.has_marker(F.lower("c0"), "STM"), "an STM tip") and not one(spark, tx.has_marker(F.lower("c0"), "STM"), "system")
    assert one(spark, tx.has_marker(F.lower("c0"), "microscopy"), "spectromicroscopy")


def test_scores(spark):
    x = sc.Inputs(*[F.lit(v) for v in (0.8, 0.6, 0.4, 0.2, 1.0)], feedback=F.lit(0.1))
    assert abs(one(spark, sc.final_score(x), "") - (0.4 * 0.8 + 0.25 * 0.6 + 0.15 * 0.4 + 0.15 * 0.2 + 0.05 + 0.1)) < 1e-12
    c = sc.Inputs(*[F.lit(1.0)] * 5, centrality=F.lit(0.5), multiplier=F.lit(0.3))
    assert abs(one(spark, sc.final_score(c), "") - 0.3 * (0.68 * 0.5 + 0.32)) < 1e-12
    assert sc.weights("no such profile", {"relevance": -1})["relevance"] == 0.0
    assert one(spark, sc.recency(F.lit(0), 2026), "") == 0.3 and one(spark, sc.recency(F.lit(2020), 2026), "") == 0.5
    d = spark.createDataFrame([(["spin", "state", "spin"],), ([],)], "t array<string>")
    got = [r.c for r in d.select(sim.tfidf_cosine("spin state", F.col("t")).alias("c")).collect()]
    assert abs(got[0] - 3 / (2**0.5 * 5**0.5)) < 1e-12 and got[1] == 0.0


@pytest.mark.parametrize("rich, want", [(False, {1: 1, 2: 2, 3: 1, 4: 2}), (True, {1: 1, 2: 2, 3: 1, 4: 1})])
def test_ordered_dedup_is_not_components(spark, rich, want):
    rows = [paper(1, "tA", "d1"), paper(2, "tB", "d2"), paper(3, "tB", "d1", "long " * 200 if rich else ""), paper(4, "tB")]
    got = {r.input_ord: r.gid for r in dedup.groups(spark.createDataFrame(rows, PAPER)).collect()}
    assert got == want


def test_merge_fills_gaps_and_is_stable(spark):
    rows = [paper(1, "Same Title", "10.1/A", "", 2020, "", 5, ["A"]), paper(2, "same title!", "https://doi.org/10.1/a", "text " * 50, None, "V", 3, ["B", "A"]), paper(3, "other")]
    d = spark.createDataFrame(rows, PAPER)
    got = {r.input_ord: r for r in dedup.deduplicate(d).collect()}
    m = got[1]
    assert len(got) == 2 and m.n_records == 2 and m.paper_id == "p2" and m.year == 2020 and m.venue == "V" and m.citation_count == 5 and m.authors == ["B", "A"] and m.source_provider == "crossref;openalex"
    again = dedup.deduplicate(dedup.deduplicate(d).drop("n_records")).drop("n_records").collect()
    assert sorted(r.paper_id for r in again) == ["p2", "p3"]
    assert {(r.input_ord, r.gid) for r in dedup.groups(d.repartition(3)).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_ordered_dedup_agrees_with_a_plain_fold(spark):
    import random

    def plain(rows):
        by_doi, by_title, state, out = {}, {}, {}, {}
        for o, doi, title, full in rows:
            g = by_doi.get(doi) if doi else None
            g = by_title.get(title) if g is None and title else g
            if g is None:
                g, state[o] = o, (doi, title, full)
            else:
                base, other = ((doi, title, full), state[g]) if full > state[g][2] else (state[g], (doi, title, full))
                state[g] = (base[0] or other[0], base[1], base[2])
            by_doi |= {state[g][0]: g} if state[g][0] else {}
            by_title |= {state[g][1]: g} if state[g][1] else {}
            out[o] = g
        return out

    rng, rows = random.Random(5), []
    for k in range(150):  # tables of their own, as their keys differ
        n_doi, n_title = rng.randint(1, 5), rng.randint(1, 5)
        for _ in range(rng.randint(2, 14)):
            doi, title = rng.choice(["", f"10.{k}/{rng.randint(1, n_doi)}"]), rng.choice(["", *[f"t{k} {rng.randint(1, n_title)}"] * 3])
            rows.append(paper(len(rows), title, doi, "x" * rng.randint(0, 900)))
    d = spark.createDataFrame(rows, PAPER)
    full = {r.input_ord: r.c for r in d.select("input_ord", dedup.completeness(d).alias("c")).collect()}
    want = plain([(r[0], r[7], r[2], full[r[0]]) for r in rows])
    assert {r.input_ord: r.gid for r in dedup.groups(d.repartition(5)).collect()} == want
    assert {r.fold for r in dedup.with_components(d).collect()} == {True, False}
    # Equal in both keys, yet apart: p3 takes the title over.
    rows = [paper(1, "t"), paper(2, "u", "d"), paper(3, "t", "d", "x" * 900), paper(4, "t")]
    assert {r.input_ord: r.gid for r in dedup.groups(spark.createDataFrame(rows, PAPER)).collect()} == {1: 1, 2: 2, 3: 2, 4: 2}


def test_large_groups_are_not_gathered(spark):
    rows = [paper(i, "Editorial", f"10.1/{i}" if i % 2 else "", authors=(f"A{i % 3}",)) for i in range(300)]
    d = spark.createDataFrame(rows, PAPER).withColumn("authors", F.when(F.col("input_ord") != 4, F.col("authors")))
    assert not any(r.fold for r in dedup.with_components(d).collect())  # one title: settled without the fold
    m = dedup.deduplicate(d)
    assert "FlatMapGroupsInPandas" not in m._jdf.queryExecution().toString()
    r = m.collect()
    assert len(r) == 1 and r[0].n_records == 300 and r[0].authors == ["A1", "A0", "A2"] and r[0].source_provider == "crossref;openalex"


def test_evidence_levels(spark):
    p = spark.createDataFrame([("a", "t", "Cats sleep. Dogs run fast here."), ("b", "t", ""), ("c", "t", "Cats sleep all day long in the sun.")], "paper_id string, title string, abstract string")
    best = {r.paper_id: r for r in evidence.best_sentence(p, "do dogs run").collect()}
    assert best["a"].evidence_sentence == "Dogs run fast here." and best["b"].limitation.startswith("Missing abstract")
    ext = spark.createDataFrame([("a", "dogs run  fast HERE.", False), ("b", "x", False), ("c", "Cats sleep all day long in the sum.", False), ("a", "purple cats invent money", True), ("zz", "x", False)], "paper_id string, evidence_sentence string, llm_used boolean")
    levels = sorted((r.paper_id, r.support_level, r.span_match_type) for r in evidence.verify(ext, p).collect())
    assert levels == [("a", "llm_invalid_evidence", "none"), ("a", "strict_support", "exact"), ("b", "missing_abstract", "none"), ("c", "strict_support", "fuzzy")]


def test_fuzzy_span_verifies_every_document(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    got = entry.queries()["fuzzy_span"](spark, d).select("paper_id").collect()
    assert len(got) == docs == len({r.paper_id for r in got})


def test_best_ratio_agrees_with_a_full_search():
    import difflib
    import random

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abc .") for _ in range(n))
    for _ in range(300):
        e, a = text(rng.randint(0, 20)), text(rng.randint(0, 120))
        best, at = 0.0, ""
        for s in re.split(r"(?<=[.!?])\s+", " ".join(a.split())):
            r = difflib.SequenceMatcher(None, evidence.py_span_text(e), evidence.py_span_text(s)).ratio() if s.strip() else 0.0
            best, at = (r, s) if r > best else (best, at)
        assert evidence.best_ratio(e, a) == (best, at)


def test_best_ratios_of_many_papers_agree_with_difflib():
    import difflib
    import random

    rng = random.Random(7)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [("", "x."), ("a", ""), ("abc", "xabc. abcx."), ("ab" * 150, f"{'ab' * 150}. x. {'ba' * 120}"), ("a", "𐐀İ. Σ A")]
    for letters in ("ab ", "abcdefgh ", "abcdefghijklmnopqrst  éİ😀"):
        for _ in range(60):
            top = rng.choice((10, 60, 199, 420))  # 200 characters are where frequent ones stop starting a block
            rows.append((text(letters, rng.randint(0, top)), ". ".join(text(letters, rng.randint(0, top)) for _ in range(rng.randint(0, 9)))))
    want = []
    for e, a in rows:
        best, at = 0.0, ""
        for s in re.split(r"(?<=[.!?])\s+", " ".join(a.split())):
            r = difflib.SequenceMatcher(None, evidence.py_span_text(e), evidence.py_span_text(s)).ratio() if s.strip() else 0.0
            best, at = (r, s) if r > best else (best, at)
        want.append((best, at))
    assert evidence.best_ratios(*zip(*rows, strict=True)) == want


def test_lithium_contract(spark):
    c = Contract("q", groups=(Group("core_topic", ("SEI",)), Group("lithium_context", ("lithium-ion battery",))))
    rows = [("a", "SEI growth in lithium-ion batteries", "The solid electrolyte interphase of a lithium-ion battery with a graphite anode.", "keyword"), ("b", "SEI in sodium-ion batteries", "SEI in a sodium-ion battery, unlike lithium-ion battery cells.", "keyword"), ("c", "Cooking", "Soup.", "keyword"), ("d", "Cooking", "", "seed_exact")]
    d = spark.createDataFrame(rows, "paper_id string, title string, abstract string, source_stage string")
    got = {r.paper_id: r for r in guardrail.assess(d, c).collect()}
    assert got["a"].domain_decision == "in_scope" and got["b"].domain_decision == "borderline" and got["b"].negative_context_match and got["c"].domain_decision == "out_of_scope" and got["d"].domain_match_score == 1.0
    assert all(0 <= r.intent_centrality_score <= 1 for r in got.values())


def test_rank_diversity_ties_and_floor(spark):
    rows = [("q", 1, "a", "V", 0.5, "keyword"), ("q", 2, "b", "v.", 0.5, "keyword"), ("q", 3, "c", "", 0.5, "keyword"), ("q", 4, "d", "W", 0.1, "manual_seed"), ("r", 1, "a", "V", 0.5, "keyword")]
    d = spark.createDataFrame(rows, "question_id string, input_ord long, paper_id string, venue string, relevance double, source_stage string").withColumns({c: F.lit(0.5) for c in ("evidence", "recency", "quality")})
    got = {(r.question_id, r.paper_id): r for r in ranking.rank(d.repartition(4)).collect()}
    assert [got["q", p].rank for p in "acbd"] == [2, 3, 4, 1] and got["q", "b"].diversity == 0.5 and got["q", "d"].final == 0.985 and got["r", "a"].rank == 1


def test_metrics_of_a_small_ranking(spark):
    r = spark.createDataFrame([("q", f"p{i}", i) for i in (1, 2, 3)], "question_id string, paper_id string, rank int")
    g = spark.createDataFrame([("p1", "Include"), ("p2", "exclude"), ("p3", "include")], "paper_id string, label string")
    m = metrics.ir_metrics(r, g, 2).first()
    assert (m.precision_at_k, m.recall_at_k) == (0.5, 0.5) and abs(m.average_precision - (1 + 2 / 3) / 2) < 1e-12
    assert metrics.ir_metrics(r, g.limit(0)).first().average_precision is None


def test_overbroad_roles(spark):
    d = spark.createDataFrame([("a", "A review of theory", ""), ("b", "review", ""), ("c", "none", ""), ("d", "an STEM study", "")], "paper_id string, title string, abstract string")
    got = {r.paper_id: r for r in roles.mark_overbroad(roles.classify(d)).collect()}
    assert got["a"].roles == ["theory_mechanism", "review_background"] and got["a"].overbroad_roles == ["review_background"] and got["c"].primary_role == "unclassified" and got["d"].roles == ["characterization_method"]


def test_preference_learning(spark):
    t = spark.createDataFrame([(f"p{i}", ("good cats purr " if i % 2 else "bad dogs bark ") * 3) for i in range(8)], "paper_id string, text string")
    lab = spark.createDataFrame([(f"p{i}", "include" if i % 2 else "exclude") for i in range(6)], "paper_id string, label string")
    for scores in (preference.classifier_scores(t, lab), preference.term_scores(t, preference.contrast(t, lab))):
        s = {r.paper_id: r.preference_score for r in scores.collect()}
        assert s["p7"] > 0.5 > s["p6"]


def test_importers(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@article{k, title = {A {Nested} Title}, author = "X Y and Z", year = 2020, doi={10.1/Q}, journal={J}}\n@misc{n, note={no title}}\n')
    good, bad = importers.read_library(spark, str(tmp_path / "a.bib"))
    r = good.first()
    assert (r.title, r.authors, r.year, r.doi, r.venue) == ("A {Nested} Title", ["X Y", "Z"], 2020, "10.1/q", "J") and bad.count() == 1
    (tmp_path / "b.ris").write_text("TY  - JOUR\nTI  - A long\n  title\nAU  - A, B\nAU  - C, D\nPY  - 2019/01\nDO  - 10.2/x\nER  - \nTY  - JOUR\nAU  - only\nER  - \n")
    good, bad = importers.read_library(spark, str(tmp_path / "b.ris"))
    assert good.first().title == "A long title" and good.first().authors == ["A, B", "C, D"] and good.first().year == 2019 and bad.count() == 1
    (tmp_path / "c.csv").write_text('Paper_Title,Summary,Pub_Year,DOI,Citations\n"One, two",text,1999,10.3/Y,7\n,lost,,,\n')
    good, bad = importers.read_library(spark, str(tmp_path / "c.csv"))
    assert (good.first().title, good.first().citation_count, good.first().doi) == ("One, two", 7, "10.3/y") and bad.count() == 1
    (tmp_path / "f.csv").write_text("paper_id,label,adjustment,note\np1,include,,\np1,exclude,,\np2,odd,0.3,n\n")
    assert {r.paper_id: (r.label, r.adjustment) for r in importers.read_feedback(spark, str(tmp_path / "f.csv")).collect()} == {"p1": ("exclude", -0.2), "p2": ("uncertain", 0.3)}
    with pytest.raises(ValueError):
        importers.detect_format("x.pdf")


def test_provider_payloads(spark, tmp_path):
    bronze = lambda x: spark.createDataFrame([(json.dumps(x),)], "payload string")
    oa = providers.openalex(bronze({"results": [{"id": "W1", "doi": "https://doi.org/10.1/A", "title": "T", "abstract_inverted_index": {"world": [1, 3], "hello": [0]}, "authorships": [{"author": {"display_name": "N"}}], "publication_year": 2020, "cited_by_count": 3, "relevance_score": 2.5, "concepts": [{"display_name": "C"}], "topics": [{"display_name": "C"}]}]})).first()
    assert (oa.abstract, oa.doi, oa.authors, oa.fields_of_study) == ("hello world world", "10.1/a", ["N"], ["C"])
    s2 = providers.semantic_scholar(bronze({"data": [{"paperId": "x", "title": "T"}, {"paperId": "y", "title": "U", "externalIds": {"DOI": "10.2/B"}}]})).collect()
    assert [r.api_relevance_score for r in s2] == [1.0, 0.5] and s2[1].doi == "10.2/b" and s2[1].provider_ids["doi"] == "10.2/B"
    cr = providers.crossref(bronze({"message": {"items": [{"title": ["T"], "DOI": "10.3/C", "container-title": ["J"], "author": [{"given": "G", "family": "F"}], "issued": {"date-parts": [[2018, 5]]}}]}})).first()
    assert (cr.year, cr.venue, cr.authors) == (2018, "J", ["G F"])
    (tmp_path / "x.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2001.00001v2</id><title>A\n title</title><summary>S</summary><published>2020-01-01T00:00:00Z</published><author><name>N</name></author><author><name>M</name></author><category term='cs'/><category term='ml'/></entry></feed>")
    ax = providers.arxiv(spark.read.format("xml").option("rowTag", "entry").load(str(tmp_path / "x.xml"))).first()
    assert (ax.paper_id, ax.title, ax.authors, ax.year, ax.fields_of_study) == ("arxiv:2001.00001", "A title", ["N", "M"], 2020, ["cs", "ml"])


def test_sinks_and_events(spark, tmp_path):
    d = spark.createDataFrame([("a|b", ["x", "y"], None)], "t string, l array<string>, n int")
    sinks.write_csv(d, str(tmp_path / "o"), ["l", "missing", "n", "t"], single=True)
    assert spark.read.csv(str(tmp_path / "o"), header=True).first().asDict() == {"l": "x; y", "missing": None, "n": None, "t": "a|b"}
    assert "a\\|b" in sinks.markdown(d)
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text('{"timestamp": "2026-01-01T00:00:00Z", "level": "info", "stage": "s", "message": "m", "details": {"api_key": "1", "n": "2"}}\n')
    assert events.read_events(spark, str(tmp_path / "log"), streaming=False).first().details == {"api_key": "[redacted]", "n": "2"}
    assert events.read_events(spark, str(tmp_path / "log")).isStreaming


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20
