"""Screening decisions, their reasons and confidence, reading priority and suggested action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.guardrail import is_user_seed, priority_limited
from quillscreen.operators.store import exploded

WEAK = ("missing_evidence", "unverified", "weak_support", "llm_invalid_evidence")
TOP_RANK, TOP_SCORE, TOP_COVERAGE, TOP_CENTRALITY, TOP_FOCUS = 12, 0.72, 0.85, 0.78, 0.65


def reason_of_forbidden(term: Column) -> Column:
    t = F.lower(term)
    return (
        F.when(t.rlike("patient screening|drug screening|biomarker"), "ambiguous_screening_meaning").when(t.rlike("materials screening|clinical|medicine"), "wrong_application_domain")
        .when(t.rlike("llm|large language model"), "general_llm_only").otherwise("off_topic_domain")
    )


def reason_of_aspect(aspect: Column) -> Column:
    t = F.lower(aspect)
    return (
        F.when(t.contains("multi") & t.contains("agent"), "no_multi_agent_component").when(t.rlike("human feedback|human-in-the-loop"), "no_human_feedback_component")
        .when(t.rlike("evidence|verification"), "no_evidence_verification_component").otherwise("missing_required_concept")
    )


def decide(items: DataFrame, keep: bool = False) -> DataFrame:
    """One decision per ranked paper; ``keep`` adds it to the paper's own columns, whose assessment stays as it is.

    ``items`` has paper_id, rank, final, evidence, multiplier, abstract, support_level, the assessment's columns, and the aspect
    columns missing_aspects, aspect_coverage_score; ``is_duplicate`` is optional, and ``no_abstract`` stands for the abstract where it exists.
    """
    none = F.array().cast("array<string>")
    dup = F.coalesce("is_duplicate", F.lit(False)) if "is_duplicate" in items.columns else F.lit(False)
    blank = F.col("no_abstract") if "no_abstract" in items.columns else tx.text("abstract") == ""
    d = items.withColumns({"__dup": dup, "__seed": is_user_seed(items), "__limited": priority_limited(items)})
    score, level, scope = F.col("final"), F.col("support_level"), F.col("domain_decision")
    code = lambda v: F.regexp_replace(F.lower(F.trim(v)), r"\s+", "_")
    one = lambda when, name: F.when(when, F.array(F.lit(name) if isinstance(name, str) else name)).otherwise(none)
    reasons = F.concat(
        one(F.col("__dup"), "duplicate"), one(scope == "out_of_scope", "off_topic_domain"), F.transform("forbidden_concepts_found", reason_of_forbidden),
        one(F.size("missing_required_concepts") > 0, "missing_required_concept"), one(F.col("missing_required_group_count") > 0, "missing_required_group"),
        one(F.col("__limited"), "missing_context_or_non_target_context"), one(F.col("peripheral_context_reason") != "", F.col("peripheral_context_reason")),
        one(blank, "missing_abstract"), one(level.isin(*WEAK), "weak_evidence_grounding"), F.transform("missing_aspects", reason_of_aspect), one(score < 0.2, "low_metadata_quality"),
    )
    d = d.withColumn("__reasons", F.array_distinct(F.filter(F.transform(reasons, code), lambda r: r != "")))
    maybe = lambda when: F.when(when, "maybe").otherwise("exclude")
    rules = [
        (F.col("__dup"), F.lit("exclude"), F.lit("duplicate")), (scope == "out_of_scope", F.lit("exclude"), F.lit("off_topic_domain")),
        (level.isin("missing_abstract", "missing_evidence"), maybe(score >= 0.35), F.when(level == "missing_abstract", "missing_abstract").otherwise("weak_evidence_grounding")),
        (level.isin("unverified", "llm_invalid_evidence"), maybe((score >= 0.45) & (scope == "in_scope")), F.lit("weak_evidence_grounding")),
        (F.col("missing_required_group_count") > 0, maybe(score >= 0.35), F.lit("missing_required_group")), (F.col("__limited"), F.lit("maybe"), F.lit("missing_context_or_non_target_context")),
        (scope == "borderline", F.lit("maybe"), F.when(F.size("__reasons") > 0, "off_topic_domain").otherwise("borderline_domain")),
        ((score >= 0.55) & (level == "strict_support") & (F.col("aspect_coverage_score") >= 0.4), F.lit("include"), F.lit("high_score_in_scope_grounded_evidence")),
        ((score >= 0.45) & level.isin("strict_support", "weak_support"), F.lit("maybe"), F.lit("partial_match_needs_inspection")),
        (score < 0.25, F.lit("exclude"), F.lit("low_metadata_quality")),
    ]
    decision, primary = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for when, what, why in rules:
        decision, primary = decision.when(when, what), primary.when(when, why)
    d = d.withColumns({"decision": decision.otherwise("maybe"), "primary_reason": primary.otherwise("partial_match_needs_inspection")})
    plain = F.col("primary_reason").isin("high_score_in_scope_grounded_evidence", "partial_match_needs_inspection", "borderline_domain")
    reasons = F.when(~plain & ~F.array_contains("__reasons", F.col("primary_reason")), F.concat(F.array("primary_reason"), "__reasons")).otherwise(F.col("__reasons"))
    match = F.col("domain_match_score")
    sure = (
        F.when(F.col("decision") == "include", 0.35 * score + 0.30 * match + 0.20 * F.col("evidence") + 0.15 * F.col("aspect_coverage_score"))
        .when(F.col("decision") == "exclude", 0.35 * (1.0 - F.col("multiplier")) + 0.25 * (1 - score) + 0.25 * (1 - match) + 0.15 * (1 - F.col("evidence")))
        .otherwise(0.45 + 0.25 * (1 - F.abs(score - 0.5)) + 0.15 * (1 - F.abs(match - 0.5)))
    )
    gated = F.exists(F.map_keys("required_group_matches"), lambda k: F.lower(k).rlike("target_chemistry|target_context"))
    top = (
        (scope == "in_scope") & (level == "strict_support") & (F.col("rank") <= TOP_RANK) & (score >= TOP_SCORE) & (F.size("negative_context_match") == 0) & (F.col("peripheral_context_reason") == "")
        & (F.col("required_group_coverage_score") >= TOP_COVERAGE) & (F.col("intent_centrality_score") >= TOP_CENTRALITY) & (F.col("topic_focus_score") >= TOP_FOCUS)
        & (~gated | (F.size("target_context_match") > 0))
    )
    priority = (
        F.when(F.col("decision") == "exclude", "exclude").when((F.col("missing_required_group_count") > 0) | F.col("__limited"), "optional")
        .when((F.col("decision") == "include") & top, "must_read").when(F.col("decision") == "include", "read_later").when(scope == "borderline", "optional").otherwise("read_later")
    )
    action = F.when(F.col("decision").isin("include", "exclude"), F.col("decision")).when(blank | level.isin("missing_abstract", "unverified", "weak_support"), "inspect_full_text").otherwise("uncertain")
    exact = F.array_contains(F.transform(F.split(tx.text("source_stage"), ";"), F.trim), "seed_exact") if "source_stage" in items.columns else F.lit(False)
    own = {
        "decision": (F.col("decision"), F.lit("include")), "decision_confidence": (tx.clamp(sure), F.lit(0.98)), "primary_reason": (F.col("primary_reason"), F.when(exact, "seed_exact_match").otherwise("user_seed")),
        "exclusion_reasons": (reasons, none), "domain_match_score": (match, F.lit(1.0)), "domain_decision": (scope, F.lit("in_scope")), "reading_priority": (priority, F.lit("must_read")), "suggested_action": (action, F.lit("include")),
    }
    if keep:
        return d.select(*items.columns, *[F.when(F.col("__seed"), s).otherwise(v).alias(k) for k, (v, s) in own.items() if k not in items.columns])
    return d.select("question_id", "paper_id", *[F.when(F.col("__seed"), s).otherwise(v).alias(k) for k, (v, s) in own.items()])


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("n_papers"))


def top_reasons(decisions: DataFrame, k: int = 12) -> DataFrame:
    """The k most common exclusion reasons, ties by name."""
    n = exploded(decisions, "exclusion_reasons", "reason").groupBy("reason").agg(F.count("*").alias("n_papers"))
    return n.orderBy(F.col("n_papers").desc(), "reason").limit(k)


def priority_policy(items: DataFrame) -> DataFrame:
    """Whether an explicit target context gates must_read, and how many papers are must_read."""
    gated = F.exists(F.map_keys("required_group_matches"), lambda k: F.lower(k).rlike("target_chemistry|target_context"))
    return items.agg(F.coalesce(F.bool_or(gated), F.lit(False)).alias("target_context_required_for_priority"), F.count_if(F.col("reading_priority") == "must_read").alias("must_read_count"))
