"""Result groups, the reading path, and other short reports over the ranked papers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.guardrail import is_user_seed
from quillscreen.operators.store import exploded

#: Section, groups it draws on (none: all ranked papers), priorities it accepts, and its size; an empty section with a
#: fallback takes the first ranked papers with those priorities.
SECTIONS = (
    ("Core First Reads", (), ("must_read",), 5, False),
    ("Method / Mechanism Papers", ("implementation_relevant", "background_or_survey"), ("must_read", "read_later"), 3, False),
    ("Evaluation Papers", ("evaluation_relevant",), ("must_read", "read_later"), 3, False),
    ("Recent Frontier / Read Later", ("recent_frontier",), ("read_later",), 3, True),
    ("Optional Peripheral / Background", ("peripheral",), ("optional",), 3, True),
)
PRIORITIES = ("must_read", "read_later", "optional")


def group_papers(items: DataFrame, intent: str = "overview") -> DataFrame:
    """Adds ``recommended_role`` and ``result_group``. ``items``: title, venue, claim, year, final, support_level, aspect_coverage_score."""
    low = F.lower(F.concat_ws(" ", tx.text("title"), tx.text("venue"), tx.text("claim")))
    seed, level, aspect = is_user_seed(items), F.col("support_level"), F.coalesce("aspect_coverage_score", F.lit(0.0))
    role = F.when(seed, "user_seed").when(level.isin("unverified", "missing_abstract", "llm_invalid_evidence"), "uncertain").when(low.contains("review") | low.contains("survey"), "background")
    if intent in ("implementation", "proposal"):
        role = role.when(low.contains("method") | low.contains("system") | low.contains("framework"), "method")
    role = role.when(low.contains("evaluation") | low.contains("benchmark") | low.contains("experiment"), "evaluation").when(F.coalesce("year", F.lit(0)) >= 2022, "future work").when(aspect >= 0.6, "motivation").otherwise("background")
    d = items.withColumn("recommended_role", role)
    r = F.col("recommended_role")
    group = (
        F.when(seed, "must_read").when(level.isin("missing_abstract", "llm_invalid_evidence"), "excluded_or_low_confidence").when((F.col("final") >= 0.65) & (aspect >= 0.5), "must_read")
        .when(r == "future work", "recent_frontier").when(r == "method", "implementation_relevant").when(r == "evaluation", "evaluation_relevant").when(r == "background", "background_or_survey")
        .when(F.col("final") < 0.25, "excluded_or_low_confidence").otherwise("peripheral")
    )
    return d.withColumn("result_group", group)


def recommendable(priorities: tuple[str, ...]):
    return (F.col("decision") != "exclude") & F.col("reading_priority").isin(*priorities) & (F.coalesce("domain_decision", F.lit("")) != "out_of_scope")


def reading_path(items: DataFrame) -> DataFrame:
    """``question_id, section_no, section, pos, rank, paper_id, title, reading_priority``; no paper twice.

    Sections claim papers in turn. All that any section could take is first cut to the best few of each (question, group,
    priority), a bounded number of rows per question, and only those meet in the sequential step.
    """
    total = sum(n for *_, n, _ in SECTIONS)
    ok = items.filter(recommendable(PRIORITIES)).select("question_id", "paper_id", "title", "rank", "result_group", "reading_priority")
    best = Window.partitionBy("question_id", "result_group", "reading_priority").orderBy("rank")
    pool = ok.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= total).drop("n")

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = pdf.sort_values("rank"), []
        for no, (name, wanted, priorities, size, fallback) in enumerate(SECTIONS, 1):
            own = left[left["reading_priority"].isin(priorities)]
            took = pd.concat([own[own["result_group"] == g] for g in wanted]) if wanted else own
            took = (own if fallback and took.empty else took).head(size)
            left = left[~left["paper_id"].isin(took["paper_id"])]
            out.append(took.assign(section_no=no, section=name, pos=range(1, len(took) + 1)))
        return pd.concat(out)[["question_id", "section_no", "section", "pos", "rank", "paper_id", "title", "reading_priority"]]

    return pool.groupBy("question_id").applyInPandas(claim, "question_id string, section_no int, section string, pos int, rank int, paper_id string, title string, reading_priority string")


def path_integrity(path: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of what must not be on a reading path; all zero when it is sound."""
    d = path.join(items.select("question_id", "paper_id", "decision", "domain_decision", "negative_context_match", F.col("reading_priority").alias("__prio")), ["question_id", "paper_id"], "left")
    return d.agg(
        F.count("*").alias("reading_path_paper_count"), F.count_if((F.col("decision") == "exclude") | (F.col("__prio") == "exclude")).alias("reading_path_exclude_count"),
        F.count_if(F.col("domain_decision") == "out_of_scope").alias("reading_path_out_of_scope_count"),
        (F.count("paper_id") - F.count_distinct("question_id", "paper_id")).alias("reading_path_duplicate_count"), F.count_if(F.size("negative_context_match") > 0).alias("reading_path_negative_context_count"),
    )


def lineage(items: DataFrame, k: int = 12) -> DataFrame:
    """The oldest papers first, unknown years last."""
    return items.orderBy(F.col("year").asc_nulls_last(), "rank").limit(k)


def read_first(items: DataFrame, k: int = 12) -> DataFrame:
    """By reading priority, then rank."""
    p = F.when(F.col("reading_priority") == "must_read", 0).when(F.col("reading_priority") == "read_later", 1).when(F.col("reading_priority") == "optional", 2).otherwise(3)
    return items.withColumn("priority_ord", p).orderBy("priority_ord", "rank").limit(k)


def auto_seeds(items: DataFrame, n: int = 5) -> DataFrame:
    """The first n supported papers that are not out of scope."""
    ok = F.col("support_level").isin("strict_support", "weak_support") & (F.coalesce("domain_decision", F.lit("")) != "out_of_scope")
    return items.filter(ok).orderBy("rank").limit(n)


def keywords(items: DataFrame, k: int = 6) -> DataFrame:
    """The k most frequent tokens of the titles and abstracts of included papers, ties by token."""
    t = exploded(items.filter(F.col("decision") == "include"), F.concat(tx.runs("title"), tx.runs("abstract")), "token")
    # Stop words are left out of the tokens, as a pattern that leaves them out of a text costs more than all else.
    n = t.groupBy("token").agg(F.count("*").alias("n")).filter(~F.col("token").isin(*tx.STOPWORDS))
    return n.orderBy(F.col("n").desc(), "token").limit(k)


def value_counts(d: DataFrame, column: str) -> DataFrame:
    """Counts of the values of a column, arrays exploded, blanks dropped; most frequent first, ties by value."""
    array = dict(d.dtypes)[column].startswith("array")
    v = (exploded(d, column, "value") if array else d.select(F.col(column).alias("value"))).select(F.col("value").cast("string").alias("value")).filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    return v.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "value")
