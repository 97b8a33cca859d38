"""Evaluation: ranking metrics against gold labels, rank shifts, support rates, screening flow and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscreen.operators.store import checkpointed, small

LOW_CONFIDENCE = ("missing_abstract", "missing_evidence", "unverified", "llm_invalid_evidence")


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def ir_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """``question_id, precision_at_k, ndcg_at_k, recall_at_k, average_precision``.

    Precision counts judged papers only; the others take an unjudged paper as not relevant and divide by all relevant labels. Without
    gold labels, or relevant ones where they are the divisor, a metric is null. Hits so far are counted over the relevant papers alone, which are as few as the
    labels, not over the whole ranking.
    """
    labels = gold.select("paper_id", F.lower(F.trim("label")).alias("gold")).filter("gold <> ''")
    n_gold = labels.agg(F.count("*").alias("n_gold"), F.count_if(F.col("gold") == "include").alias("n_rel"))
    # Three branches read the ranking, so its keys are evaluated once.
    ranked = checkpointed(ranked.select("question_id", "paper_id", "rank"))
    judged = ranked.join(labels, "paper_id")
    rel = judged.filter(F.col("gold") == "include").withColumn("hits", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))
    top = F.col("rank") <= k
    by_rel = rel.groupBy("question_id").agg(F.sum(F.when(top, F.lit(1.0) / F.log2(F.col("rank") + 1))).alias("dcg"), F.count_if(top).alias("hits_k"), F.sum(F.col("hits") / F.col("rank")).alias("ap"))
    by_judged = judged.groupBy("question_id").agg(F.count_if(top).alias("judged_k"))
    d = ranked.select("question_id").distinct().join(by_rel, "question_id", "left").join(by_judged, "question_id", "left").join(F.broadcast(n_gold))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int"))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    some = F.col("n_rel") > 0
    return d.select(
        "question_id", _ratio(zero("hits_k"), zero("judged_k"), None).alias("precision_at_k"), F.when(some, zero("dcg") / ideal).alias("ndcg_at_k"),
        F.when(some, zero("hits_k") / F.col("n_rel")).alias("recall_at_k"), F.when(some, zero("ap") / F.col("n_rel")).alias("average_precision"),
    )


def rank_shift(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """How a re-rank moved the papers: number moved, mean and largest distance, and changes among the first k."""
    b = before.select("question_id", "paper_id", F.col("rank").alias("b"))
    a = after.select("question_id", "paper_id", F.col("rank").alias("a"))
    d = b.join(a, ["question_id", "paper_id"], "full_outer")
    delta = F.abs(F.col("b") - F.col("a"))
    moved = F.coalesce(delta > 0, F.lit(False))
    in_top = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    return d.groupBy("question_id").agg(F.count_if(moved).alias("moved_count"), F.coalesce(F.avg(F.when(moved, delta)), F.lit(0.0)).alias("mean_abs_rank_delta"), F.coalesce(F.max(F.when(moved, delta)), F.lit(0)).alias("max_abs_rank_delta"), F.count_if(in_top("b") != in_top("a")).alias("top10_changed_count"))


def top_movers(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """The k papers that moved farthest, ties by the new rank."""
    b = before.select("question_id", "paper_id", F.col("rank").alias("before_rank"))
    d = b.join(after.select("question_id", "paper_id", F.col("rank").alias("after_rank")), ["question_id", "paper_id"]).filter("before_rank <> after_rank")
    return d.withColumn("delta", F.col("before_rank") - F.col("after_rank")).orderBy(F.abs("delta").desc(), "after_rank").limit(k)


def support_summary(verification: DataFrame) -> DataFrame:
    """Counts and rates of support levels; grounding accuracy leaves out papers without abstract or evidence."""
    level = lambda v: F.count_if(F.col("support_level") == v)
    n, auditable = F.count("*"), F.count_if(~F.col("support_level").isin("missing_abstract", "missing_evidence"))
    return verification.agg(
        n.alias("n_papers"), level("strict_support").alias("strict_supported_count"), level("weak_support").alias("weak_support_count"), level("unverified").alias("unverified_count"),
        level("llm_invalid_evidence").alias("llm_invalid_evidence_count"), _ratio(level("missing_abstract"), n).alias("missing_abstract_ratio"), _ratio(F.count_if(~F.col("supported")), n).alias("unsupported_claim_rate"),
        _ratio(level("strict_support"), auditable).alias("grounding_accuracy"), _ratio(level("strict_support"), n).alias("strict_support_rate"), _ratio(level("weak_support"), n).alias("weak_support_rate"),
    )


def screening_flow(items: DataFrame, raw_count: int, duplicate_count: int, top_k: int = 10) -> DataFrame:
    """One row of screening-flow counts over the merged, ranked and decided papers."""
    count = lambda c: F.count_if(c)
    return items.agg(
        F.lit(raw_count).cast("long").alias("records_identified"), F.lit(duplicate_count).cast("long").alias("duplicates_removed"), count(F.coalesce("abstract", F.lit("")) == "").alias("missing_abstracts"),
        F.count("*").alias("records_screened"), count(F.col("decision") == "include").alias("records_included"), count(F.col("decision") == "maybe").alias("records_maybe"),
        count(F.col("decision") == "exclude").alias("records_excluded"), count(F.col("domain_decision") == "out_of_scope").alias("out_of_domain_records"),
        F.least(F.count("*"), F.lit(top_k)).alias("records_in_top_ranked"), count(F.col("support_level").isin(*LOW_CONFIDENCE)).alias("records_low_confidence"),
    )


def ablation_deltas(runs: DataFrame, metrics: tuple[str, ...], baseline: str = "full_system") -> DataFrame:
    """Each run's metrics less those of its case's baseline; null where either is not a number."""
    base = runs.filter(F.col("config") == baseline).select("case_id", *[F.col(m).try_cast("double").alias(f"__{m}") for m in metrics])
    d = runs.join(small(base), "case_id", "left")
    return d.select("case_id", "config", *[(F.col(m).try_cast("double") - F.col(f"__{m}")).alias(f"delta_{m}") for m in metrics])


def coverage_of_anchors(texts: DataFrame, anchors: dict[str, tuple[str, ...]], text_col: str = "text") -> DataFrame:
    """``anchor_coverage``: the share of any-of anchor groups found in the lower-cased text of each row, at four decimals."""
    low, flags = F.lower(F.coalesce(text_col, F.lit(""))), []
    for terms in anchors.values():
        hit = F.lit(False)
        for t in terms:
            hit = hit | low.contains(t.lower())
        flags.append(hit.cast("int"))
    share = sum(flags, F.lit(0)) / F.lit(float(len(anchors))) if anchors else F.lit(0.0)
    return texts.withColumn("anchor_coverage", F.round(share, 4))


def exploration_quality(items: DataFrame, roles: DataFrame, target_roles: tuple[str, ...]) -> DataFrame:
    """Shares of a run: supported papers, papers with a role, target roles found, in-scope papers, seeds used."""
    r = roles.agg(F.count_if(F.size("roles") > 0).alias("with_role"), F.count("*").alias("n_roles"), F.array_distinct(F.flatten(F.collect_set("roles"))).alias("seen"))
    i = items.agg(F.count("*").alias("n"), F.count_if(F.col("support_level") == "strict_support").alias("strict"), F.count_if(F.col("domain_decision") == "in_scope").alias("scope"))
    found = F.size(F.array_intersect("seen", F.array(*[F.lit(t) for t in target_roles])))
    return i.join(F.broadcast(r)).select(_ratio(F.col("strict"), F.col("n")).alias("evidence_grounding_ratio"), _ratio(F.col("scope"), F.col("n")).alias("in_scope_ratio"), _ratio(F.col("with_role"), F.col("n_roles")).alias("role_assigned_ratio"), (found / F.lit(float(max(1, len(target_roles))))).alias("target_role_coverage"))
