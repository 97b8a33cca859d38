"""Metrics of a ranked run as rows of a table, compiled into one conditional aggregate over one pass.

A metric names a measure, a set of papers, a cut-off of the rank and a predicate. All metrics of a run are expressions of one
``agg``: the ranked papers are read once whatever the number of metrics, and one row per question is shuffled. Texts are only searched in rows that
some metric with that predicate looks at.

Defined cases: a run without papers has counts of zero and null means, shares and lists; null values are left out of means, null sets and predicates are false; a
share of an empty set is null; metrics of a predicate that was not given are null, not zero; papers without a rank are in no cut-off.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.diagnostics import matched_patterns

COUNT, MEAN, SHARE, RANKS = "count", "mean", "share", "ranks"
#: The papers of a run by their standing; a paper can be in several sets.
SETS: dict[str, str] = {
    "all": "true", "must_read": "lower(trim(reading_priority)) = 'must_read'", "include": "lower(trim(decision)) = 'include'", "maybe": "lower(trim(decision)) = 'maybe'",
    "optional": "lower(trim(decision)) = 'optional' OR lower(trim(reading_priority)) = 'optional'",
    "exclude": "lower(trim(decision)) = 'exclude' OR lower(trim(reading_priority)) = 'exclude' OR lower(trim(domain_decision)) IN ('exclude', 'out_of_scope')",
}
#: What can hold of a paper without a search of its text.
HOLDS: dict[str, str] = {
    "out_of_scope": "domain_decision = 'out_of_scope'", "borderline": "domain_decision = 'borderline'", "in_scope": "domain_decision = 'in_scope'", "missing_abstract": "coalesce(abstract, '') = ''", "supported": "support_level = 'strict_support'",
    "missing_group": "missing_required_group_count > 0", "negative_term": "size(negative_domain_matches) > 0", "peripheral": "peripheral_context_reason <> ''", "undated": "year IS NULL", "uncited": "coalesce(citation_count, 0) = 0",
}
TEXT = "forbidden"
#: The columns of a ranked row whose texts are searched, where they exist.
FIELDS = (
    "title", "abstract", "claim", "evidence", "evidence_sentence", "matched_evidence_sentence", "supporting_sentence", "matched_sentence", "abstract_snippet", "relevance_reason", "off_topic_reason",
    "primary_reason",
)


@dataclass(frozen=True)
class Metric:
    """``share`` is the part of the set within the cut-off where ``where`` holds, ``but_not`` where it does not."""

    name: str
    measure: str = COUNT
    of: str = "all"
    top: int | None = None
    where: str | None = None
    but_not: bool = False
    column: str | None = None


def standard_metrics() -> list[Metric]:
    """The metrics that an evaluation reports by name."""
    out = [Metric("ranked_count"), *(Metric(f"{s}_count", of=s) for s in SETS if s != "all")]
    for k in (10, 20):
        out += [Metric(f"forbidden_pattern_top{k}_count", COUNT, top=k, where=TEXT), Metric(f"forbidden_pattern_top{k}_rows", RANKS, top=k, where=TEXT), Metric(f"negative_context_top{k}", COUNT, top=k, where=TEXT)]
    out += [Metric("top20_false_positive_count", COUNT, top=20, where=TEXT), Metric("top20_false_positive_rows", RANKS, top=20, where=TEXT)]
    for s in ("must_read", "include"):
        out += [Metric(f"forbidden_pattern_{s}_count", of=s, where=TEXT), Metric(f"negative_context_{s}", of=s, where=TEXT)]
    out += [Metric("must_read_false_positive_count", of="must_read", where=TEXT), Metric("must_read_precision_heuristic", SHARE, of="must_read", where=TEXT, but_not=True)]
    return [*out, Metric("required_group_coverage_top10", MEAN, top=10, column="required_group_coverage_score"), Metric("intent_centrality_mean_top10", MEAN, top=10, column="intent_centrality_score")]


def grid(sets: Sequence[str] = ("all", "must_read", "include", "maybe"), tops: Sequence[int | None] = (10, 20, 50, None), holds: Sequence[str] = tuple(HOLDS), means: Sequence[str] = ("topic_focus_score", "aspect_coverage_score", "domain_match_score", "final")) -> list[Metric]:
    """Counts of every predicate in every set and cut-off, and means of the scores in every cut-off."""
    cut = lambda k: f"top{k}" if k else "overall"
    counts = [Metric(f"{h}_{s}_{cut(k)}", COUNT, s, k, h) for s in sets for k in tops for h in holds]
    return counts + [Metric(f"{c}_mean_{cut(k)}", MEAN, "all", k, column=c) for c in means for k in tops]


def _any(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def marked(papers: DataFrame, patterns: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """Adds ``forbidden``: whether a text of the paper has one of the patterns, so that the texts need not be kept until the run is ranked."""
    whole = F.concat_ws(" ", *[tx.text(f) for f in fields if f in papers.columns])
    return matched_patterns(papers.withColumn("__text", whole), "__text", tuple(patterns), "__found").withColumn(TEXT, F.size("__found") > 0).drop("__text", "__found")


def evaluate(ranked: DataFrame, metrics: Sequence[Metric], patterns: Sequence[str] = (), fields: Sequence[str] = FIELDS, sets: Mapping[str, str] = SETS, holds: Mapping[str, str] = HOLDS, by: str = "question_id") -> DataFrame:
    """One row per question with a column per metric.

    ``ranked`` has ``rank`` and the columns that the sets, predicates and means name. ``patterns`` make the predicate ``forbidden``, which
    holds if a text of the paper has one of them; without patterns its metrics are null. Where the papers carry a column ``forbidden`` of marked(), it stands for
    their texts, and ``no_abstract`` stands for the abstract.
    """
    if "no_abstract" in ranked.columns and "abstract" not in ranked.columns:
        holds = dict(holds) | {"missing_abstract": "no_abstract"}
    unknown = {m.of for m in metrics} - set(sets) | {m.where for m in metrics} - set(holds) - {None, TEXT}
    if unknown:
        raise ValueError(f"no such set or predicate: {', '.join(sorted(map(str, unknown)))}")
    inside = {s: F.coalesce(F.expr(sets[s]), F.lit(False)) for s in {m.of for m in metrics}}
    d = ranked.withColumns({f"__in_{s}": c for s, c in inside.items()} | {f"__is_{w}": F.coalesce(F.expr(holds[w]), F.lit(False)) for w in {m.where for m in metrics} - {None, TEXT}})

    def within(m: Metric) -> Column:
        return F.col(f"__in_{m.of}") if m.top is None else F.col(f"__in_{m.of}") & (F.col("rank") <= m.top)

    searched = [within(m) for m in metrics if m.where == TEXT]
    if TEXT in ranked.columns:
        d = d.withColumn(f"__is_{TEXT}", F.col(TEXT))
    elif searched and patterns:
        # Blank where no metric looks, so only the texts of those rows are searched.
        whole = F.when(_any(searched), F.concat_ws(" ", *[tx.text(f) for f in fields if f in ranked.columns])).otherwise("")
        d = matched_patterns(d.withColumn("__text", whole), "__text", tuple(patterns), "__found").withColumn(f"__is_{TEXT}", F.size("__found") > 0)
    total = []
    for m in metrics:
        if m.where == TEXT and not patterns and TEXT not in ranked.columns:
            total.append(F.lit(None).cast({COUNT: "bigint", RANKS: "array<int>"}.get(m.measure, "double")).alias(m.name))
            continue
        at = within(m)
        hit = at if m.where is None else at & (F.col(f"__is_{m.where}") != F.lit(m.but_not))
        if m.measure == COUNT:
            value = F.count_if(hit)
        elif m.measure == SHARE:
            value = F.try_divide(F.count_if(hit).cast("double"), F.count_if(at).cast("double"))
        elif m.measure == MEAN:
            value = F.avg(F.when(hit, F.col(m.column).cast("double")))
        elif m.measure == RANKS:
            value = F.array_sort(F.collect_list(F.when(hit, F.col("rank"))))
        else:
            raise ValueError(f"no such measure: {m.measure}")
        total.append(value.alias(m.name))
    return d.groupBy(by).agg(*total)


def long(evaluated: DataFrame, by: str = "question_id") -> DataFrame:
    """``by, metric, value, listed``: one row per metric; lists of ranks are joined by commas in ``listed``, and their value is their length."""
    kinds = dict(evaluated.dtypes)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if kinds[c].startswith("array") else F.lit(None).cast("string")
    value = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("double") if kinds[c].startswith("array") else F.col(c).cast("double")
    each = [F.struct(F.lit(c).alias("metric"), value(c).alias("value"), listed(c).alias("listed")) for c in evaluated.columns if c != by]
    return evaluated.select(by, F.inline(F.array(*each)))
