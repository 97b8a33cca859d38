"""Retrieval provenance: which planned query brought a paper, what each query returned, and what state each provider is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.guardrail import is_user_seed

#: Drift categories and the markers that betray them.
DRIFT = (
    ("healthcare_screening_drift", ("patient screening", "drug screening", "biomarker", "medicine", "clinical")),
    ("biological_agent_drift", ("biological agent", "infectious agent", "chemical agent")),
    ("materials_screening_drift", ("materials screening", "high-throughput materials")),
    ("llm_agent_drift", ("llm agent", "large language model", "software agent")),
)
DROP_RATE, REPAIR_RATE = 0.8, 0.35


def planned_stages(queries: DataFrame, openalex_mode: str = "keyword+semantic") -> DataFrame:
    """Each planned query once per retrieval stage; one provider has two where its mode asks for both."""
    both = [("keyword", "openalex_keyword"), ("semantic", "openalex_semantic")]
    modes = {"keyword": both[:1], "semantic": both[1:]}.get(openalex_mode, both)
    stage = lambda m, s: F.struct(F.lit(m).alias("search_mode"), F.lit(s).alias("retrieval_stage"))
    other = F.array(F.struct(F.lit("keyword").alias("search_mode"), F.col("provider").alias("retrieval_stage")))
    stages = F.when(F.col("provider") == "openalex", F.array(*[stage(m, s) for m, s in modes])).otherwise(other)
    return queries.withColumn("__s", F.explode(stages)).select("*", "__s.search_mode", "__s.retrieval_stage").drop("__s")


def annotate(papers: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds matched_query, _source, _family, _lens and _purpose: of the same provider and query first (retrieval before source provider),
    else of the first planned query with the same text. ``queries`` has ord, provider, query, source, family_name, lens_name, purpose.
    """
    rec = F.struct("source", "family_name", "lens_name", "purpose")
    planned = queries.groupBy("provider", "query").agg(F.max_by(rec, "ord").alias("r"))
    by_query = queries.filter("query <> ''").groupBy("query").agg(F.min_by(rec, "ord").alias("r"))
    hit = lambda key, to: planned.select(F.col("provider").alias(f"__p_{to}"), F.col("query").alias(f"__q_{to}"), F.col("r").alias(to))
    d, q = papers, tx.text("retrieval_query")
    for key, to in (("retrieval_provider", "__r1"), ("source_provider", "__r2")):
        d = d.join(hit(key, to), (F.col(key) == F.col(f"__p_{to}")) & (q == F.col(f"__q_{to}")), "left")
    d = d.join(by_query.select(F.col("query").alias("__q3"), F.col("r").alias("__r3")), q == F.col("__q3"), "left")
    d = d.withColumn("__r", F.when(q != "", F.coalesce("__r1", "__r2", "__r3")))
    found = F.col("__r").isNotNull()
    stage = F.when(found & (F.col("__r.source") == "query_family") & ~is_user_seed(papers), "query_family").otherwise(F.col("source_stage"))
    return d.select(
        *[c for c in papers.columns if c != "source_stage"], stage.alias("source_stage"), F.when(found, q).alias("matched_query"), F.col("__r.source").alias("matched_query_source"),
        F.col("__r.family_name").alias("matched_query_family"), F.col("__r.lens_name").alias("matched_lens"), F.col("__r.purpose").alias("matched_query_purpose"),
    )


def linked(papers: DataFrame, queries: DataFrame) -> DataFrame:
    """``paper_id, linked_lenses, linked_query_families``: over every planned query among a paper's ';'-joined ones whose provider, if both are known, agrees."""
    split = lambda c: F.filter(F.transform(F.split(tx.text(c), ";"), tx.collapsed), lambda x: x != "")
    d = papers.select("paper_id", F.array_distinct(F.concat(split("retrieval_provider"), split("source_provider"))).alias("__p"), F.explode(F.array_distinct(split("retrieval_query"))).alias("__q"))
    d = d.join(queries, F.col("__q") == F.col("query")).filter((F.size("__p") == 0) | (F.col("provider") == "") | F.array_contains("__p", F.col("provider")))
    listed = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"]), lambda v: v != ""))
    return d.groupBy("paper_id").agg(listed("lens_name").alias("linked_lenses"), listed("family_name").alias("linked_query_families"))


def query_results(queries: DataFrame, bundles: DataFrame) -> DataFrame:
    """Planned queries with the number of papers they returned and the ordered ids; ``bundles`` has ord, provider, query, paper_count, paper_ids."""
    got = bundles.groupBy("provider", "query").agg(F.sum("paper_count").alias("paper_count"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "paper_ids"))), lambda x: x["paper_ids"]))).alias("paper_ids"))
    return queries.join(got, ["provider", "query"], "left").withColumns({"paper_count": F.coalesce("paper_count", F.lit(0)), "paper_ids": F.coalesce("paper_ids", F.array().cast("array<string>"))})


def provider_status(bundles: DataFrame, requested: DataFrame) -> DataFrame:
    """State of each requested provider. ``bundles``: provider, returned, status_code, error; ``requested``: provider, requested."""
    error = (F.coalesce("error", F.lit("")) != "") | F.coalesce(F.col("status_code") != 0, F.lit(False))
    n = bundles.groupBy("provider").agg(F.count("*").alias("attempted"), F.sum("returned").alias("returned"), F.count_if(error).alias("errors"), F.bool_or(F.coalesce(F.col("status_code") == 429, F.lit(False))).alias("rate_limited"))
    d = requested.join(n, "provider", "left")
    d = d.select("provider", "requested", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("attempted", "returned", "errors")], F.coalesce("rate_limited", F.lit(False)).alias("rate_limited"))
    some = F.col("returned") > 0
    state = (
        F.when(F.col("rate_limited") & some, "partial_success_rate_limited").when(F.col("rate_limited"), "rate_limited").when((F.col("errors") > 0) & some, "partial_success")
        .when(F.col("errors") > 0, "failed").when(some, "success").when(F.col("attempted") > 0, "success_no_results").otherwise("not_attempted")
    )
    early = (F.col("requested") > 0) & (F.col("attempted") < F.col("requested"))
    return d.withColumn("status", state).withColumn("stopped_after", F.when(early | F.col("rate_limited"), F.col("attempted")))


def retrieval_context(status: DataFrame, merged: int, ranked: int, max_per_query: int) -> DataFrame:
    """One row: what the provider states amount to."""
    ok = F.count_if(F.col("status").isin("success", "success_no_results", "partial_success", "partial_success_rate_limited"))
    bad = F.count_if(F.col("status").isin("failed", "rate_limited", "partial_success", "partial_success_rate_limited"))
    d = status.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "not_attempted").alias("idle"), ok.alias("ok"), bad.alias("bad"))
    idle = F.lit(max_per_query <= 0) | (F.col("n") == F.col("idle"))
    state = F.when(idle, "planning_only").when((F.col("ok") > 0) & (F.col("bad") > 0), "partial_success").when((F.col("ok") > 0) & F.lit(merged > 0), "success").otherwise("failed")
    d = d.withColumn("retrieval_status", state)
    real = F.col("retrieval_status").isin("success", "partial_success") & F.lit(merged > 0 and ranked > 0)
    reason = F.when(F.col("retrieval_status") == "planning_only", "retrieval_not_performed").when(F.col("retrieval_status") == "failed", "insufficient_screened_papers").otherwise("")
    return d.select("retrieval_status", real.alias("ranked_papers_based_on_real_retrieval"), reason.alias("reason"))


def pilot_results(hits: DataFrame, assessments: DataFrame) -> DataFrame:
    """What a pilot says of each (provider, query, stage): off-topic rate, drift and whether to keep, repair or drop the query.

    ``hits`` has provider, query, retrieval_stage, paper_id; a query without hits is to be listed with a null paper_id.
    """
    d = hits.join(assessments.select("paper_id", "domain_decision", "off_topic_reason", "negative_domain_matches", "forbidden_concepts_found"), "paper_id", "left")
    text = F.lower(F.concat_ws(" ", F.array_join("negative_domain_matches", " "), F.array_join("forbidden_concepts_found", " "), "off_topic_reason"))
    flags = []
    for name, markers in DRIFT:
        hit = F.lit(False)
        for m in markers:
            hit = hit | text.contains(m)
        flags.append(F.coalesce(F.bool_or(hit), F.lit(False)).alias(name))
    judged = F.col("domain_decision").isNotNull()
    d = d.groupBy("provider", "query", "retrieval_stage").agg(F.count("paper_id").alias("pilot_raw_count"), F.coalesce(F.avg(F.when(judged, (F.col("domain_decision") != "in_scope").cast("double"))), F.lit(0.0)).alias("__rate"), *flags)
    names = [n for n, _ in DRIFT]
    drift = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]), lambda v: v.isNotNull())
    d = d.withColumn("detected_drift", drift)
    action = F.when(F.col("pilot_raw_count") == 0, "repair").when(F.col("__rate") >= DROP_RATE, "drop").when((F.col("__rate") >= REPAIR_RATE) | (F.size("detected_drift") > 0), "repair").otherwise("keep")
    return d.select("provider", "query", "retrieval_stage", "pilot_raw_count", F.round("__rate", 4).alias("off_topic_rate_estimate"), "detected_drift", action.alias("recommendation"))


def capped_queries(queries: DataFrame, per_provider: int = 18) -> DataFrame:
    """Final queries: families in descending priority and name, each up to its budget, a query text once per provider, and a cap per provider."""
    text = F.lower(tx.collapsed("query"))
    once = Window.partitionBy("provider", "__text").orderBy(F.col("priority").desc(), "family_name", "ord")
    d = queries.withColumn("__text", text).withColumn("__once", F.row_number().over(once)).filter("__once = 1")
    d = d.withColumn("__own", F.row_number().over(Window.partitionBy("provider", "family_name").orderBy("ord"))).filter(F.col("__own") <= F.col("budget"))
    d = d.withColumn("pos", F.row_number().over(Window.partitionBy("provider").orderBy(F.col("priority").desc(), "family_name", "ord")))
    return d.filter(F.col("pos") <= per_provider).drop("__text", "__once", "__own")


def year_filter(papers: DataFrame, from_year: int) -> DataFrame:
    """Papers of ``from_year`` or later; the user's seeds always stay and papers without a year go."""
    return papers.filter(is_user_seed(papers) | (F.coalesce("year", F.lit(0)) >= from_year))


def year_filter_audit(papers: DataFrame, from_year: int) -> DataFrame:
    seed, year = is_user_seed(papers), F.coalesce("year", F.lit(0))
    return papers.agg(
        F.count("*").alias("before_count"), F.count_if(seed | (year >= from_year)).alias("after_count"), F.count_if(~seed & (year == 0)).alias("dropped_missing_year"),
        F.count_if(~seed & (year != 0) & (year < from_year)).alias("dropped_too_old"), F.count_if(seed & (year < from_year)).alias("kept_seed_exempt"),
    )


def query_flags(queries: DataFrame, query: str = "query", axes: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """Quality flags of query texts: overbroad (under three distinct tokens), a word three times or a repeated word pair, and, with axes
    (any-of term groups), single_axis where at most one of them is touched."""
    d = queries.withColumn("__t", F.filter(F.split(F.lower(tx.collapsed(query)), " "), lambda x: x != ""))
    n = F.greatest(F.size("__t") - 1, F.lit(0))
    d = d.withColumn("__p", F.zip_with(F.slice("__t", F.lit(1), n), F.slice("__t", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))
    d = d.withColumn("__s", F.array_sort("__t"))
    m = F.greatest(F.size("__s") - 2, F.lit(0))
    thrice = F.exists(F.zip_with(F.slice("__s", F.lit(1), m), F.slice("__s", F.lit(3), m), lambda a, b: a == b), lambda x: x)
    touched = F.lit(0)
    for terms in axes:
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.lower(tx.text(query)).contains(t.lower())
        touched = touched + hit.cast("int")
    return d.withColumns({
        "overbroad": F.size(F.array_distinct(tx.tokens(query))) < 3, "repeated": thrice | (F.size(F.array_distinct("__p")) < F.size("__p")), "single_axis": (touched <= 1) if axes else F.lit(False),
    }).drop("__t", "__p", "__s")
