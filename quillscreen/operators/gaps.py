"""Research tensions and gaps: rules of markers matched against papers, and counted signals of what is undercovered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.store import exploded, small


@dataclass(frozen=True)
class TensionRule:
    """A tension is seen where a marker occurs; with two sides, seeing both makes it surer."""

    key: str
    markers: tuple[str, ...] = ()
    side_a: tuple[str, ...] = ()
    side_b: tuple[str, ...] = ()


def folded_marker(lowered: Column, marker: str) -> Column:
    """Markers of up to three characters need word boundaries, longer ones are substrings."""
    m = marker.lower()
    return lowered.rlike(rf"\b{tx.java_quote(m)}\b") if len(m) <= 3 else lowered.contains(m)


def _any(lowered: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | folded_marker(lowered, m)
    return out


#: Latin letters with marks and their plain forms, for marker search.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), MARKED, PLAIN)


def tensions(papers: DataFrame, rules: tuple[TensionRule, ...]) -> DataFrame:
    """``tension_key, n_papers, confidence`` of every rule that a paper supports; one pass over the papers for all rules."""
    low = papers.select("paper_id", folded(F.concat_ws(" ", tx.text("title"), tx.text("abstract"))).alias("x"))
    hits = [F.struct(F.lit(r.key).alias("tension_key"), F.lit(bool(r.side_a and r.side_b)).alias("sided"), _any(F.col("x"), r.side_a).alias("a"), _any(F.col("x"), r.side_b).alias("b"), _any(F.col("x"), (*r.markers, *r.side_a, *r.side_b)).alias("any")) for r in rules]
    d = exploded(low, F.filter(F.array(*hits), lambda h: h["any"]), "h", "paper_id").select("paper_id", "h.*")
    n = F.count_distinct("paper_id")
    sure = F.when(F.first("sided"), F.when(F.bool_or("a") & F.bool_or("b"), 0.82).otherwise(0.56)).otherwise(F.least(F.lit(0.9), 0.5 + 0.1 * n))
    return d.groupBy("tension_key").agg(n.alias("n_papers"), F.round(sure, 2).alias("confidence"))


def gap_matrix(aspects: DataFrame, reasons: DataFrame, required: DataFrame, keys: DataFrame, k: int = 8) -> DataFrame:
    """``gap_key, signals, related_aspects``: the k gaps with most signals, ties by key.

    Signals are missing aspects (one each), exclusion reasons (their counts, unless general) and required aspects without a supporting
    paper (one). ``keys`` maps a phrase to its gap; unknown phrases are general.
    """
    a = exploded(aspects, "missing_aspects", "phrase").select("phrase", F.lit(1).cast("long").alias("n"), F.lit("aspect").alias("kind"))
    r = reasons.select(F.col("reason").alias("phrase"), F.col("n_papers").alias("n"), F.lit("reason").alias("kind"))
    q = required.select(F.col("aspect").alias("phrase"), F.when(F.col("supported"), 0).otherwise(1).cast("long").alias("n"), F.lit("required").alias("kind"))
    d = a.union(r).union(q).join(small(keys), "phrase", "left").withColumn("gap_key", F.coalesce("gap_key", F.lit("general_relevance")))
    d = d.filter("gap_key <> 'general_relevance'").groupBy("gap_key").agg(F.sum("n").alias("signals"), F.array_join(F.sort_array(F.collect_set("phrase")), "; ").alias("related_aspects"))
    return d.filter("signals > 0").orderBy(F.col("signals").desc(), "gap_key").limit(k)


def mentioned(gap_terms: dict[str, tuple[str, ...]]) -> Column:
    """The gaps whose terms a paper's title or abstract mentions."""
    low = F.lower(F.concat_ws(" ", tx.text("title"), tx.text("abstract")))
    return F.filter(F.array(*[F.when(_any(low, terms), F.lit(g)) for g, terms in gap_terms.items()]), lambda g: g.isNotNull())


def supporting_titles(items: DataFrame, gap_terms: dict[str, tuple[str, ...]], k: int = 3) -> DataFrame:
    """``gap_key, pos, paper_id``: for each gap the first k papers by rank that mention one of its terms. ``gap_keys`` of mentioned() stand for the texts where they exist."""
    keys = F.col("gap_keys") if "gap_keys" in items.columns else mentioned(gap_terms)
    d = exploded(items, keys, "gap_key", "paper_id", "rank").select("paper_id", "rank", "gap_key")
    w = Window.partitionBy("gap_key").orderBy("rank")
    return d.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
