"""Aspect coverage: which required aspects a paper's text covers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import matcher
from quillscreen.functions import similarity as sim
from quillscreen.functions import text as tx
from quillscreen.operators.guardrail import joined_text

SIMILAR = 0.18


def parse(aspect: str) -> tuple[str, list[str]]:
    """Label and terms of ``label: term; term``; an aspect without a colon is its own term."""
    cleaned = " ".join(aspect.split())
    label, colon, rest = cleaned.partition(":")
    if not colon:
        return cleaned, [cleaned] if cleaned else []
    return " ".join(label.split()), [t for t in (" ".join(x.split()) for x in re.split(r"[;,|]", rest)) if t]


def queries(aspects: tuple[str, ...]) -> list[str]:
    """What the text of a paper is compared with: the terms of each aspect, or its label."""
    return [t for a in aspects if a for t in parse(a)[1] or [parse(a)[0]]]


def coverage(papers: DataFrame, aspects: tuple[str, ...], stop_words: tuple[str, ...] = tx.STOPWORDS, keep: bool = False, lowered: Column | None = None, stats: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """``paper_id, title, covered_aspects, missing_aspects, aspect_coverage_score`` in one projection; ``keep`` adds them to the paper's own columns.

    An aspect is covered if one of its terms occurs as a phrase or with all its tokens, or resembles the text by 0.18 or more.
    Columns ``claim`` and ``evidence_sentence`` are used where they exist. ``lowered`` is their
    joined text in lower case and ``stats`` the square sum and the counts of its words, where they were found before.
    """
    wanted = [a for a in aspects if a]
    if lowered is None:
        lowered = F.lower(joined_text(papers, ("title", "abstract", "tldr", "fields_of_study", "claim", "evidence_sentence")))
    d = papers.withColumn("__low", lowered)
    flags, terms_in, found = {}, matcher.Present("__in"), {}
    if stats is None:
        every = sim.wanted_words(queries(aspects), stop_words)
        found["__n"] = sim.text_stats([F.col("__low")], [[0]], every, stop_words)
        stats = sim.Stats("__n", every).of(0)
    for i, a in enumerate(wanted):
        label, terms = parse(a)
        hit = F.lit(False)
        for t in terms or [label]:
            hit = hit | terms_in.has_term(t) | (sim.tfidf_cosine(t, None, stop_words, *stats) >= SIMILAR)
        flags[f"__a{i}"] = hit
    # Both searches of the text are columns of one step, so that it goes to the workers once.
    d = d.withColumns(found | {"__in": terms_in.column(F.col("__low"))}).drop("__low").withColumns(flags) if flags else d
    pick = lambda want: F.filter(F.array(*[F.when(F.col(f"__a{i}") == want, F.lit(parse(a)[0])) for i, a in enumerate(wanted)]), lambda v: v.isNotNull()) if wanted else F.array().cast("array<string>")
    d = d.select(*(papers.columns if keep else ("paper_id", "title")), pick(True).alias("covered_aspects"), pick(False).alias("missing_aspects"))
    return d.withColumn("aspect_coverage_score", F.size("covered_aspects") / F.lit(float(len(wanted))) if wanted else F.lit(0.0))
