"""Ranking: preliminary score, venue diversity, final score, seed floor, research adjustments and re-ranks.

All ranks are stable: ties keep the order of the step before. What is ranked are narrow rows of keys and scores, read from the stored papers; whole papers
are never sorted. Up to ``ALONE`` keys go through a window by question, or question and venue; more are ranked in blocks, whose sort is a range shuffle,
so that no task holds a question or a venue. The ranks meet the papers again in one hash join on a number of the stored row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscreen.functions import scoring as sc
from quillscreen.functions import text as tx
from quillscreen.operators.guardrail import is_user_seed
from quillscreen.operators.store import checkpointed, small, written

ROW = "__row"
#: Keys that one task may sort; a key with its scores takes about a hundred bytes.
ALONE = 500_000
EXACT_FLOOR, MANUAL_FLOOR = 0.995, 0.985
#: Additions by role, for questions without a domain of their own.
ROLE_VALUES = {
    "theory_mechanism": 0.012, "characterization_method": 0.012, "in_situ_operando": 0.014, "ex_situ_post_mortem": 0.010, "material_case": 0.008, "application_performance": 0.008,
    "failure_limitation": 0.010, "controversy_debate": 0.010, "review_background": 0.003, "peripheral_background": -0.004, "out_of_scope": -0.02,
}
ROLE_OTHERWISE, ROLE_REVIEW, ROLE_CASE = 0.015, 0.003, 0.008
#: Additions by role in the one domain that has its own; a role that is too common counts for two fifths.
FERROELECTRIC_ROLES = {
    "theory_origin": 0.10, "direct_probe_method": 0.12, "surface_probe_method": 0.12, "experimental_proof": 0.10, "interface_screening": 0.12, "material_case": 0.08,
    "device_application": 0.05, "application_bridge": 0.05, "review_background": 0.04, "limitation_or_challenge": 0.04,
}
FERROELECTRIC_FALSE = ("drug screening", "clinical screening", "cognitive screening", "cell surface polarization", "generic solvent screening", "cosmo solvent")
FERROELECTRIC = "ferroelectric_polarization"


def numbered(keys: DataFrame, by: list[str], order: list[Column], to: str = "rank") -> DataFrame:
    """``keys``, a stored table of narrow rows, with the 1-based number of each row among those that agree in ``by``."""
    if keys.count() <= ALONE:
        return keys.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered_in_blocks(keys, by, order, to)


def numbered_in_blocks(d: DataFrame, by: list[str], order: list[Column], to: str) -> DataFrame:
    """numbered() for groups that may hold most rows: a range shuffle by group and order, a row number inside each range, and the sizes of the earlier
    ranges of the group, one row per range, added to it."""
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored, as the bounds of a range shuffle are sampled and two evaluations need not agree.
    dealt = written(d.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = small(written(before.filter("__before > 0").select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__p").alias("__at"), "__before")))
    inner = F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*order))
    met = F.col("__p") == F.col("__at")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    # Only groups that began in an earlier range have rows in ``before``; their number is at most that of the ranges.
    total = (F.coalesce("__before", F.lit(0)) + F.col("__in")).cast("int")
    return dealt.withColumn("__in", inner).join(before, met, "left").withColumn(to, total).select(*d.columns, to)


def stable_rank(d: DataFrame, score: str, tie: str, to: str = "rank") -> DataFrame:
    """1-based rank by descending score, ties by the earlier order. Rows that rank() numbered are ranked by their keys alone, others are stored first."""
    if ROW not in d.columns:
        d = stored(d)
    keys = numbered(written(d.select(ROW, "question_id", score, tie)), ["question_id"], [F.col(score).desc(), F.col(tie).asc()], to)
    return d.join(keys.select(ROW, to), ROW)


def rank_in_blocks(d: DataFrame, score: str, tie: str, to: str = "rank") -> DataFrame:
    """stable_rank() for a question that may hold most rows, in blocks whatever their number."""
    return numbered_in_blocks(d, ["question_id"], [F.col(score).desc(), F.col(tie)], to)


def stored(d: DataFrame) -> DataFrame:
    """``d`` evaluated once, with a number for each row."""
    return written(d.withColumn(ROW, F.monotonically_increasing_id()))


def _floored(d: DataFrame, score: Column) -> Column:
    exact = F.array_contains(F.transform(F.split(tx.text("source_stage"), ";"), F.trim), "seed_exact") if "source_stage" in d.columns else F.lit(False)
    return F.when(is_user_seed(d), F.greatest(score, F.when(exact, EXACT_FLOOR).otherwise(MANUAL_FLOOR))).otherwise(score)


def rank(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Two-pass rank. ``scored`` has question_id, input_ord, venue and the columns relevance, evidence, recency, quality;
    optional columns are centrality, multiplier, source_stage and seed_relation.

    Pass one scores with diversity 0.5; a paper's diversity is then 1 / (number of papers of its venue so far), the venue's
    normalised name blank for unknown; pass two scores again and ranks, ties by the order of pass one.
    """
    return rank_stored(stored(scored), weights).drop(ROW)


def rank_stored(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """rank() of stored() papers, which keep the numbers of their rows."""
    w = weights or sc.weights()
    cols = set(scored.columns)
    opt = lambda c: F.col(c) if c in cols else None
    inputs = lambda diversity: sc.Inputs(F.col("relevance"), F.col("evidence"), F.col("recency"), F.col("quality"), diversity, opt("centrality"), opt("multiplier"), weights=w)
    d = scored.withColumn("final0", _floored(scored, sc.final_score(inputs(F.lit(0.5)))))
    key = tx.title_key("venue")
    d = d.withColumn("venue_key", F.when(key == "", "unknown").otherwise(key))
    parts = [c for c in ("relevance", "evidence", "recency", "quality", "centrality", "multiplier", "source_stage", "seed_relation") if c in cols]
    keys = written(d.select(ROW, "question_id", "venue_key", "final0", "input_ord", *parts))
    keys = numbered(keys, ["question_id", "venue_key"], [F.col("final0").desc(), F.col("input_ord").asc()], "__n")
    keys = keys.withColumn("diversity", F.lit(1.0) / F.col("__n"))
    keys = keys.withColumn("final", _floored(keys, sc.final_score(inputs(F.col("diversity")))))
    own = ["final0", "venue_key", "diversity", "final"]
    keys = written(keys.select(ROW, "question_id", "input_ord", *own))
    keys = numbered(keys, ["question_id"], [F.col("final").desc(), F.col("final0").desc(), F.col("input_ord").asc()])
    return scored.join(keys.select(ROW, *own, "rank"), ROW)


def role_adjustment(roles: Column, primary: Column, overbroad: Column, domain: str = "") -> Column:
    """What a paper's roles add to its score; null roles (no record) add nothing."""
    if domain == FERROELECTRIC:
        best = _best(roles, FERROELECTRIC_ROLES)
        best = F.coalesce(F.greatest(best, F.when(F.exists(roles, lambda r: ~r.isin(*FERROELECTRIC_ROLES)), 0.0)), F.lit(0.0))
        value = F.when(overbroad, F.round(best * 0.4, 4)).otherwise(best)
    else:
        known = F.exists(roles, lambda r: r.isin(*ROLE_VALUES))
        # Roles outside the table count as zero beside those in it.
        best = F.array_max(F.transform(roles, lambda r: _lookup(r, ROLE_VALUES)))
        other = F.when(primary == "review_background", ROLE_REVIEW).when(primary.isin("material_case", "limitation_or_challenge"), ROLE_CASE).otherwise(ROLE_OTHERWISE)
        value = F.when(overbroad, 0.0).when(known, best).otherwise(other)
    return F.when(roles.isNull(), 0.0).otherwise(value)


def _lookup(role: Column, table: dict[str, float]) -> Column:
    out = F.when(F.lit(False), 0.0)
    for k, v in table.items():
        out = out.when(role == k, v)
    return out.otherwise(0.0)


def _best(roles: Column, table: dict[str, float]) -> Column:
    return F.array_max(F.transform(roles, lambda r: _lookup(r, table)))


def lane(d: DataFrame) -> Column:
    """seed, query_family:<name>, another query source, the source stage, or keyword."""
    have = lambda c: tx.text(c) if c in d.columns else F.lit("")
    source, family, stage = have("matched_query_source"), have("matched_query_family"), have("source_stage")
    return F.when(is_user_seed(d), "seed").when(source == "query_family", F.concat(F.lit("query_family:"), F.when(family == "", "unknown").otherwise(family))).when(source != "", source).when(stage != "", stage).otherwise("keyword")


def lane_adjustment(lane_col: Column, domain: str = "") -> Column:
    family = F.lit(0.012)
    if domain == FERROELECTRIC:
        family = F.when(lane_col.rlike("direct_probe_methods|interface_screening|theory_origin"), 0.04).otherwise(0.025)
    return F.when(lane_col == "seed", 0.03).when(lane_col.startswith("query_family"), family).otherwise(0.0)


def title_boost(d: DataFrame, seed_titles: tuple[str, ...]) -> Column:
    """Seeds, and papers whose title holds the title of a seed hint."""
    title, hit = tx.collapsed(F.lower(tx.text("title"))), F.lit(False)
    for t in seed_titles:
        cleaned = " ".join(t.lower().split())
        hit = hit | title.contains(cleaned) if cleaned else hit
    return F.when(is_user_seed(d), 0.05).when(hit, 0.035).otherwise(0.0)


def false_positive_penalty(d: DataFrame, domain: str = "") -> Column:
    out = F.when(F.lit(False), 0.0)
    if domain == FERROELECTRIC:
        low = F.lower(F.concat_ws(" ", tx.text("title"), tx.text("abstract"), tx.text("venue")))
        false = F.lit(False)
        for t in FERROELECTRIC_FALSE:
            false = false | low.contains(t)
        out = out.when(false, 0.20).when((low.contains("surface plasmon polariton") | low.contains("thin film deposition")) & ~low.contains("ferroelectric"), 0.10)
    return out.when(F.col("domain_decision") == "out_of_scope", 0.05).when(F.col("domain_decision") == "borderline", 0.015).otherwise(0.0)


def boosted(d: DataFrame, seed_titles: tuple[str, ...] = (), domain: str = "") -> DataFrame:
    """Adds what the texts and the scope of a paper change in its score, so that adjust() needs no text."""
    return d.withColumns({"seed_boost": title_boost(d, seed_titles), "false_positive_penalty": false_positive_penalty(d, domain)})


def adjust(ranked: DataFrame, roles: DataFrame | None = None, seed_titles: tuple[str, ...] = (), domain: str = "") -> DataFrame:
    """Adds the role, lane, seed and false-positive adjustments, clamps, and ranks again, ties by the rank before.

    Without ``roles`` the papers carry their own ``roles, primary_role, overbroad_role_warning``. Columns of boosted() are used if there are any.
    """
    broad = F.coalesce(F.col("overbroad_role_warning") != "", F.lit(False))
    if roles is not None:
        ranked = ranked.join(roles.select("paper_id", "roles", "primary_role", "overbroad_role_warning"), "paper_id", "left")
    d = ranked.withColumn("__broad", broad).drop("overbroad_role_warning")
    d = d.withColumn("lane", lane(d))
    d = d if "seed_boost" in d.columns else boosted(d, seed_titles, domain)
    d = d.withColumns({
        "role_adjustment": role_adjustment(F.col("roles"), F.col("primary_role"), F.col("__broad"), domain), "lane_adjustment": lane_adjustment(F.col("lane"), domain), "rank_before": F.col("rank"),
    })
    d = d.withColumn("final", tx.clamp(F.col("final") + F.col("role_adjustment") + F.col("lane_adjustment") + F.col("seed_boost") - F.col("false_positive_penalty")))
    return stable_rank(d.drop("rank", "__broad"), "final", "rank_before")


def apply_feedback(ranked: DataFrame, feedback: DataFrame, preference: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Rescores the papers with feedback or a learned preference and ranks again.

    A touched paper is scored from its base parts alone: without the centrality blend, role, lane and seed adjustments. An untouched one keeps its score.
    """
    d = ranked.join(feedback.select("paper_id", F.col("label").alias("feedback_label"), "adjustment"), "paper_id", "left")
    d = d.join(preference, "paper_id", "left") if preference is not None else d.withColumn("preference_score", F.lit(None).cast("double"))
    parts = sc.Inputs(F.col("relevance"), F.col("evidence"), F.col("recency"), F.col("quality"), F.col("diversity"), None, F.col("multiplier") if "multiplier" in ranked.columns else None, F.col("adjustment"), F.col("preference_score"), weights or sc.weights())
    touched = F.col("feedback_label").isNotNull() | F.col("preference_score").isNotNull()
    d = d.withColumn("final", F.when(touched, sc.final_score(parts)).otherwise(F.col("final"))).withColumnRenamed("rank", "rank_before")
    return stable_rank(d, "final", "rank_before")
