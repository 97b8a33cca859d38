"""The retrieval protocol: stored responses first, one partition per request, error rows, year bounds, and provenance where it is empty."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillscreen.sources import retrieval as rt

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REQUESTS = "provider string, query string, max_results int, from_year int, hit string"


class Fake:
    """Answers from a list of years; writes down what it was asked in its titles."""

    def __init__(self, kind, years, fail=()):
        self.kind, self.years, self.fail = kind, years, fail

    def search(self, query, max_results, from_year=None, search_mode="keyword"):
        if query in self.fail:
            raise TimeoutError("slow " + query)
        if query == "limited":
            return {"error": "rate_limited", "error_message": "429"}
        years = [y for y in self.years if from_year is None or y >= from_year]
        if self.kind == "openalex":
            return {"results": [{"id": f"W{query}{y}", "title": f"{query} {search_mode} {from_year}", "publication_year": y} for y in years]}
        return {"data": [{"paperId": f"{query}{y}", "title": f"{query} {y}", "abstract": "text" if y > 2000 else None, "year": y} for y in years]}


class Plain:
    """A client that takes no further arguments, and one answer without results."""

    def search(self, query, max_results, from_year=None):
        return {"message": {"items": [] if query == "none" else [{"DOI": "10.1/" + query, "title": [query]}]}}


CLIENTS = {"openalex": Fake("openalex", [1990, 2005, 2020], ("bad",)), "semantic_scholar": Fake("s2", [1990, 2005, 2020]), "crossref": Plain()}


def test_papers_errors_and_provenance(spark, tmp_path):
    asked = [("openalex", "ion", 2, None), ("OpenAlex", " ion ", 2, None), ("openalex", "bad", 5, None), ("openalex", "limited", 5, 2000), ("semantic_scholar", "ion", 5, 2000), ("crossref", "doi", 1, None), ("crossref", "none", 1, None), ("crossref", "zero", 0, None), ("crossref", None, 3, None)]
    requests = spark.createDataFrame([(*a, "clash") for a in asked], REQUESTS)
    papers, told = rt.retrieve(requests, f"{tmp_path}/bronze", CLIENTS)
    got = sorted((r.provider, r.query, r.retrieval_stage, r.n_papers, r.n_missing_abstract, r.error) for r in told.collect())
    assert got == sorted([
        ("openalex", "ion", "openalex_keyword", 2, 2, ""), ("openalex", "ion", "openalex_semantic", 2, 2, ""), ("openalex", "bad", "openalex_keyword", 0, 0, "TimeoutError"), ("openalex", "bad", "openalex_semantic", 0, 0, "TimeoutError"),
        ("openalex", "limited", "openalex_keyword", 0, 0, "rate_limited"), ("openalex", "limited", "openalex_semantic", 0, 0, "rate_limited"), ("semantic_scholar", "ion", "semantic_scholar", 2, 0, ""),
        ("crossref", "doi", "crossref", 1, 1, ""), ("crossref", "none", "crossref", 0, 0, ""), ("crossref", "zero", "crossref", 0, 0, ""), ("crossref", "", "crossref", 0, 0, ""),
    ])
    found = {(r.paper_id, r.retrieval_stage): r for r in papers.collect()}
    assert len(found) == 7
    semantic = found["openalex:Wion1990", "openalex_semantic"]
    assert (semantic.title, semantic.source_stage, semantic.retrieval_query, semantic.retrieval_provider) == ("ion semantic None", "semantic", "ion", "openalex")
    assert found["s2:ion2020", "semantic_scholar"].semantic_scholar_rank == 2
    # A second run asks for nothing that is stored; what failed before is asked again.
    again, told = rt.retrieve(requests, f"{tmp_path}/bronze", {k: rt.Offline() for k in CLIENTS})
    states = {(r.query, r.retrieval_stage): (r.n_papers, r.cached, r.error) for r in told.collect()}
    assert states["ion", "openalex_semantic"] == (2, True, "") and states["bad", "openalex_keyword"] == (0, False, "ConnectionError") and states["none", "crossref"] == (0, True, "")
    assert again.count() == 7


def test_each_request_is_a_partition_and_years_are_pushed(spark):
    rows = [{"cache_key": str(i), "provider": "semantic_scholar", "query": q, "search_mode": "keyword", "retrieval_stage": "semantic_scholar", "max_results": 9, "from_year": None} for i, q in enumerate(("a", "b", "limited"))]
    source = rt.scan(spark, rows, CLIENTS)
    assert source.rdd.getNumPartitions() == 3 and source.count() == 7
    recent = rt.scan(spark, rows, CLIENTS).filter(F.col("year") >= 2000).filter(F.col("year") > 2004).select("item").collect()
    assert len(recent) == 4
    reader = rt.PlannedReader({"requests": "[]", "clients": ""})
    assert len(list(reader.pushFilters([rt.GreaterThanOrEqual(("year",), 2000), rt.GreaterThan(("year",), 2004), rt.GreaterThan(("hit",), 1)]))) == 3 and reader.from_year == 2005


def test_unknown_providers_and_empty_plans(spark, tmp_path):
    requests = spark.createDataFrame([("nowhere", "x", 1, None, "")], REQUESTS)
    with pytest.raises(ValueError, match="unknown provider: nowhere"):
        rt.retrieve(requests, f"{tmp_path}/b", CLIENTS)
    papers, told = rt.retrieve(requests.limit(0), f"{tmp_path}/b", CLIENTS)
    assert papers.collect() == [] and told.collect() == []


def test_stamp_keeps_what_is_there(spark):
    d = spark.createDataFrame([("own", "", "p", "s", "q", "semantic"), (None, "seed_exact", "p", "s", "q", "keyword")], "retrieval_query string, source_stage string, __provider string, __stage string, __query string, __mode string")
    got = {(r.retrieval_query, r.source_stage, r.retrieval_provider, r.retrieval_stage) for r in rt.stamp(d).collect()}
    assert got == {("own", "semantic", "p", "s"), ("q", "seed_exact", "p", "s")}
