"""Evidence: the best sentence of an abstract for a question, its verification against the abstract, and its function."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import blocks
from quillscreen.functions import text as tx

FUZZY = 0.92
#: Papers whose sentences are compared at once.
ROWS = 4000
#: First match wins.
EVIDENCE_FUNCTIONS = (
    ("review_background", ("review", "overview")),
    ("reports_limitation", ("limitation", "defect", "defects", "roughness", "finite temperature", "paramagnetic", "paramagnetism")),
    ("measures_spin_polarization", ("spin polarization", "spin-resolved", "spin-polarized photoemission", "spin polarized photoemission")),
    ("directly_images_signal", ("imaging", "image", "images", "domains")),
    ("reports_surface_probe", ("peem", "mfm", "spleem", "stm", "sp-stm")),
    ("predicts_effect", ("we predict", "calculation", "first-principles", "first principles", "symmetry")),
    ("connects_to_application", ("exchange bias", "memory", "readout", "spintronics")),
    ("reports_experiment", ("we report", "we observe", "experiment", "experimental", "measured", "measurement", "measurements")),
    ("defines_concept", ("define", "defines", "defined as", "definition", "concept", "classification")),
)


def best_sentence(papers: DataFrame, question: str) -> DataFrame:
    """One evidence row per paper: the sentence with the largest token overlap, the earliest on ties.

    The arg-max runs over the array of a row, so papers are neither exploded nor shuffled.
    """
    s = papers.withColumn("__s", tx.sentences("abstract"))
    scored = F.transform("__s", lambda x, i: F.struct(tx.overlap(tx.tokens(x), question).alias("ov"), (-i).alias("neg"), x.alias("s")))
    best = s.withColumn("__b", F.array_max(scored)).withColumn("__sent", F.coalesce("__b.s", F.lit(""))).withColumn("__ov", F.coalesce("__b.ov", F.lit(0.0)))
    shared = F.array_join(F.slice(tx.overlap_terms(tx.tokens("__sent"), question), 1, 8), ", ")
    blank = F.coalesce("abstract", F.lit("")) == ""
    reason = F.when(blank, "No abstract available for rule-based extraction.").when(F.size("__s") == 0, "Abstract could not be split into evidence sentences.").otherwise(
        F.concat(F.lit("Selected for overlap with question terms: "), F.when(shared == "", "no direct keyword overlap").otherwise(shared), F.lit("."))
    )
    limit = F.when(blank, "Missing abstract; no claim was generated.").when(F.size("__s") == 0, "No sentence-level evidence was extracted.").when(F.col("__ov") > 0, "").otherwise("Selected sentence has weak lexical overlap.")
    return best.select("paper_id", "title", F.col("__sent").alias("claim"), F.col("__sent").alias("evidence_sentence"), reason.alias("relevance_reason"), limit.alias("limitation"), F.col("__ov").alias("keyword_overlap"), F.lit(False).alias("llm_used"))


def span_text(c: str | Column) -> Column:
    """Collapsed, lower-cased text with plain quotes, for span search."""
    return F.translate(F.lower(tx.collapsed(c)), "“”’", "\"\"'")


def py_span_text(value: str) -> str:
    return re.sub(r"\s+", " ", value or "").strip().lower().translate(str.maketrans("“”’", "\"\"'"))


def best_ratio(evidence: str, abstract: str) -> tuple[float, str]:
    """The best similarity of the evidence to a sentence, the earliest on ties, below the threshold too."""
    return best_ratios([evidence], [abstract])[0]


def best_ratios(evidence: Sequence[str], abstracts: Sequence[str]) -> list[tuple[float, str]]:
    """best_ratio() of many rows.

    A row's sentences are compared in the order of the similarity that their lengths allow, one, then four more and so on by fours while any could
    still reach the best; the pairs of all rows are compared together (``functions.blocks``).
    """
    wanted, kept, texts, row = [py_span_text(e) for e in evidence], [], [], []
    for r, abstract in enumerate(abstracts):
        # Neither collapsing nor lower case moves a sentence's end, so both are done once for all sentences.
        flat = " ".join((abstract or "").split())
        if flat:
            kept += (own := re.split(r"(?<=[.!?])\s+", flat))
            texts += re.split(r"(?<=[.!?])\s+", py_span_text(flat))
            row += [r] * len(own)
    row, n = np.array(row, np.int64), np.array([len(t) for t in texts], np.int64)
    m = np.array([len(w) for w in wanted], np.int64)[row]
    bound = np.where(m + n > 0, 2.0 * np.minimum(m, n) / np.maximum(m + n, 1), 1.0)
    order = np.lexsort((np.arange(len(row)), -bound, row))
    place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    best, at = np.zeros(len(wanted)), np.full(len(wanted), -1, np.int64)
    wave = 1
    while len(order):
        now = order[place < wave]
        now = now[(bound[now] > 0) & (bound[now] >= best[row[now]])]
        if len(now):
            got = blocks.matched([(wanted[row[k]], texts[k]) for k in now], row[now], best)
            for k, score in zip(now, got, strict=True):
                r = row[k]
                if score > best[r] or score == best[r] and score > 0 and k < at[r]:
                    best[r], at[r] = score, k
        order, place, wave = order[place >= wave], place[place >= wave], 4 * wave + 1
    return [(float(b), kept[k] if k >= 0 else "") for b, k in zip(best, at, strict=True)]


def verify(evidence: DataFrame, papers: DataFrame) -> DataFrame:
    """``paper_id, supported, confidence, support_level, span_match_type, span_match_confidence, matched_text``.

    Evidence without a paper is dropped. Contained spans are settled natively; only the others reach the Python similarity.
    """
    rows = evidence.join(papers.select("paper_id", "abstract"), "paper_id").withColumns({"__e": span_text("evidence_sentence"), "__a": span_text("abstract")})
    rows = rows.withColumn("__exact", (F.col("__e") != "") & F.col("__a").contains(F.col("__e")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = rows.withColumn("__level", F.when(blank("abstract"), "missing_abstract").when(blank("evidence_sentence"), "missing_evidence").when(F.col("__exact"), "strict_support"))
    out = ["paper_id", "supported", "confidence", "support_level", "span_match_type", "span_match_confidence", "matched_text"]
    settled = rows.filter(F.col("__level").isNotNull())
    good = F.col("__level") == "strict_support"
    one = good.cast("double")
    settled = settled.select("paper_id", good.alias("supported"), one.alias("confidence"), F.col("__level").alias("support_level"), F.when(good, "exact").otherwise("none").alias("span_match_type"), one.alias("span_match_confidence"), F.when(good, F.col("evidence_sentence")).otherwise("").alias("matched_text"))
    token_share = F.when(F.size(F.array_distinct(tx.tokens("evidence_sentence"))) == 0, 0.0).otherwise(F.size(F.array_intersect(tx.tokens("evidence_sentence"), tx.tokens("abstract"))) / F.size(F.array_distinct(tx.tokens("evidence_sentence"))))
    back = F.when(F.size(F.array_distinct(tx.tokens("abstract"))) == 0, 0.0).otherwise(F.size(F.array_intersect(tx.tokens("abstract"), tx.tokens("evidence_sentence"))) / F.size(F.array_distinct(tx.tokens("abstract"))))
    rest = rows.filter(F.col("__level").isNull()).select("paper_id", "evidence_sentence", "abstract", "llm_used", token_share.alias("__share"), back.alias("__back"))

    def fuzzy(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            got = []
            for k in range(0, len(part), ROWS):
                got += best_ratios(part["evidence_sentence"].iloc[k : k + ROWS], part["abstract"].iloc[k : k + ROWS])
            yield part.assign(ratio=[g[0] for g in got], best=[g[1] for g in got])

    schema = "paper_id string, evidence_sentence string, abstract string, llm_used boolean, __share double, __back double, ratio double, best string"
    rest = rest.mapInPandas(fuzzy, schema)
    ok, weak = F.col("ratio") >= FUZZY, (F.col("__share") >= 0.65) & ~F.col("llm_used")
    level = F.when(ok, "strict_support").when(weak, "weak_support").when(F.col("llm_used"), "llm_invalid_evidence").otherwise("unverified")
    sure = F.when(ok, F.col("ratio")).when(weak, tx.clamp(0.5 + 0.5 * F.col("__share"))).otherwise(F.col("__back"))
    rest = rest.select("paper_id", ok.alias("supported"), sure.alias("confidence"), level.alias("support_level"), F.when(ok, "fuzzy").otherwise("none").alias("span_match_type"), F.col("ratio").alias("span_match_confidence"), F.col("best").alias("matched_text"))
    return settled.select(*out).union(rest.select(*out))


def exact_verification(evidence: DataFrame, papers: DataFrame) -> DataFrame:
    """verify() for rule-mode evidence, which is a sentence of its abstract: native only, nothing is left for the similarity."""
    rows = evidence.join(papers.select("paper_id", "abstract"), "paper_id")
    level = F.when(F.coalesce("abstract", F.lit("")) == "", "missing_abstract").when(F.coalesce("evidence_sentence", F.lit("")) == "", "missing_evidence")
    level = level.when(span_text("abstract").contains(span_text("evidence_sentence")), "strict_support").otherwise("unverified")
    return rows.select("paper_id", (level == "strict_support").alias("supported"), (level == "strict_support").cast("double").alias("confidence"), level.alias("support_level"))


def evidence_function(sentence: str | Column, title: str | Column, abstract: str | Column) -> Column:
    """What a piece of evidence contributes to an argument, by the first list with a marker in the text."""
    low = F.lower(F.concat_ws(" ", tx.text(sentence), tx.text(title), tx.text(abstract)))
    out = F.when(F.trim(low) == "", "unknown")
    for name, markers in EVIDENCE_FUNCTIONS:
        hit = F.lit(False)
        for m in markers:
            hit = hit | low.contains(m)
        out = out.when(hit, name)
    return out.otherwise("unknown")
