"""Flat rows of the run's tables: fixed columns in a fixed order, as strings, for the CSV sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.sources.sinks import flat

#: The columns of a paper, of a piece of evidence with its verification, and of a ranked paper, in the order of the files.
PAPER = (
    "paper_id", "title", "authors", "year", "venue", "doi", "url", "source_provider", "retrieval_provider", "retrieval_stage", "retrieval_query", "source_stage", "seed_paper_id",
    "seed_title", "seed_reason", "seed_relation", "seed_confidence", "citation_count",
)
EVIDENCE = (
    "paper_id", "title", "claim", "evidence_sentence", "evidence_function", "relevance_reason", "limitation", "keyword_overlap", "supported", "confidence", "error_type", "support_level",
    "span_match_type", "span_match_confidence", "matched_text", "strict_span_validated", "llm_invalid_evidence", "missing_abstract", "rationale",
)
RANKED = (
    "rank", *(c for c in PAPER if c != "authors"), "relevance_score", "evidence_score", "recency_score", "quality_score", "diversity_score", "aspect_coverage_score", "intent_centrality_score",
    "required_group_coverage_score", "missing_required_group_count",
)
#: Columns with four decimals, and the names that scores have in the plan.
DECIMALS = ("seed_confidence", "keyword_overlap", "confidence", "span_match_confidence", "aspect_coverage_score", "intent_centrality_score", "required_group_coverage_score")
SCORES = {f"{c}_score": c for c in ("relevance", "evidence", "recency", "quality", "diversity")}


def four(c: str | Column) -> Column:
    """Four decimals; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string("%.4f", c.cast("double")))


def _rows(d: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    wide = d.withColumns({c: four(c) for c in DECIMALS if c in columns and c in d.columns})
    return flat(wide, list(columns))


def paper_rows(papers: DataFrame) -> DataFrame:
    """A seed confidence or a year of zero counts as none, like an absent one."""
    zero = {c: F.when(F.col(c) != 0, F.col(c)) for c in ("seed_confidence", "year") if c in papers.columns}
    return _rows(papers.withColumns(zero) if zero else papers, PAPER)


def evidence_rows(d: DataFrame) -> DataFrame:
    """Evidence beside its verification; the flags follow the support level."""
    level = F.col("support_level")
    flags = {"strict_span_validated": level == "strict_support", "llm_invalid_evidence": level == "llm_invalid_evidence", "missing_abstract": level == "missing_abstract"}
    return _rows(d.withColumns(flags), EVIDENCE)


def ranked_rows(items: DataFrame) -> DataFrame:
    """Ranked papers with their score parts at four decimals."""
    year = {"year": F.when(F.col("year") != 0, F.col("year"))} if "year" in items.columns else {}
    return _rows(items.withColumns(year | {to: four(c) for to, c in SCORES.items()}), RANKED)
