"""Score components and their weighted sum, as Column expressions in [0, 1]."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillscreen.functions.text import clamp

PARTS = ("relevance", "evidence", "recency", "quality", "diversity")
#: Weights of PARTS by ranking profile.
PROFILES = {
    "balanced": (0.40, 0.25, 0.15, 0.15, 0.05),
    "relevance_first": (0.55, 0.25, 0.08, 0.08, 0.04),
    "high_quality_review": (0.30, 0.20, 0.10, 0.35, 0.05),
    "overview": (0.35, 0.20, 0.10, 0.25, 0.10),
    "frontier": (0.42, 0.18, 0.25, 0.10, 0.05),
    "implementation": (0.42, 0.25, 0.10, 0.15, 0.08),
    "proposal": (0.40, 0.20, 0.15, 0.15, 0.10),
    "systematic_review": (0.34, 0.28, 0.08, 0.25, 0.05),
}
#: Parts of hybrid relevance.
HYBRID = {"title_similarity": 0.30, "abstract_similarity": 0.25, "evidence_similarity": 0.15, "api_relevance": 0.10, "must_term_coverage": 0.10, "field_match": 0.10}
CENTRALITY_SHARE, ASPECT_SHARE, PREFERENCE_WEIGHT = 0.68, 0.15, 0.10


def weights(profile: str = "balanced", overrides: dict[str, float] | None = None) -> dict[str, float]:
    """A profile's weights, an unknown profile being balanced, with non-negative overrides; they are not normalised again."""
    found = dict(zip(PARTS, PROFILES.get(profile, PROFILES["balanced"]), strict=True))
    return found | {k: max(0.0, float(v)) for k, v in (overrides or {}).items() if k in found}


def recency(year: Column, now_year: int) -> Column:
    """Steps by age; a missing year, or year 0, scores 0.3."""
    age = F.greatest(F.lit(0), F.lit(now_year) - year)
    steps = F.when(age <= 1, 1.0).when(age <= 3, 0.9).when(age <= 5, 0.75).when(age <= 10, 0.5).otherwise(0.25)
    return F.when(year.isNull() | (year == 0), 0.3).otherwise(steps)


def quality(citations: Column, venue: Column) -> Column:
    """Three quarters for citations on a log scale that is full at 999, one quarter for a known venue."""
    cited = clamp(F.log10(F.greatest(F.lit(0), F.coalesce(citations, F.lit(0))) + 1) / 3.0)
    return clamp(0.75 * cited + 0.25 * F.when(F.coalesce(venue, F.lit("")) != "", 1.0).otherwise(0.3))


def evidence(supported: Column, confidence: Column, question_overlap: Column) -> Column:
    return clamp(0.60 * F.when(supported, clamp(confidence)).otherwise(0.0) + 0.40 * question_overlap)


def api_relevance(score: Column) -> Column:
    """Provider scores up to 1 stay, larger ones become x / (x + 1)."""
    x = F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0)))
    return F.when(x <= 1.0, x).otherwise(x / (x + 1.0))


def hybrid(parts: dict[str, Column]) -> Column:
    return clamp(sum((w * clamp(parts[k]) for k, w in HYBRID.items() if k in parts), F.lit(0.0)))


def with_aspects(relevance: Column, aspect: Column) -> Column:
    """Aspect coverage is blended in only where it is not exactly zero."""
    return F.when(aspect != 0, clamp((1 - ASPECT_SHARE) * relevance + ASPECT_SHARE * aspect)).otherwise(relevance)


def domain_multiplier(decision: Column) -> Column:
    """Factor by domain decision; no assessment means no penalty."""
    return F.when(decision == "out_of_scope", 0.3).when(decision == "borderline", 0.7).otherwise(1.0)


@dataclass(frozen=True)
class Inputs:
    """Components of the final score; ``centrality``, ``multiplier``, ``feedback`` and ``preference`` are optional."""

    relevance: Column
    evidence: Column
    recency: Column
    quality: Column
    diversity: Column
    centrality: Column | None = None
    multiplier: Column | None = None
    feedback: Column | None = None
    preference: Column | None = None
    weights: dict[str, float] = field(default_factory=weights)


def base_score(x: Inputs) -> Column:
    """Weighted sum, plus feedback, plus a tenth of the preference's distance from one half; not clamped."""
    total = sum((x.weights[p] * clamp(getattr(x, p)) for p in PARTS), F.lit(0.0))
    if x.feedback is not None:
        total = total + F.coalesce(x.feedback, F.lit(0.0))
    if x.preference is not None:
        total = total + F.when(x.preference.isNotNull(), PREFERENCE_WEIGHT * (clamp(x.preference) - 0.5)).otherwise(0.0)
    return total


def pre_domain_score(x: Inputs) -> Column:
    """The base score, blended with centrality and clamped where a centrality exists."""
    base = base_score(x)
    if x.centrality is None:
        return base
    return F.when(x.centrality.isNotNull(), clamp(CENTRALITY_SHARE * clamp(x.centrality) + (1 - CENTRALITY_SHARE) * base)).otherwise(base)


def final_score(x: Inputs) -> Column:
    return pre_domain_score(x) * (F.lit(1.0) if x.multiplier is None else clamp(F.coalesce(x.multiplier, F.lit(1.0))))
