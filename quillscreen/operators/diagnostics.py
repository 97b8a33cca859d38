"""Diagnostics of a run: what retrieval brought, how the ranking came about, how good its queries were, and what to search next."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.provenance import query_flags

#: Provider states that count as a success, and those that do not.
SUCCESS = ("success", "success_no_results", "partial_success", "partial_success_rate_limited")
FATAL = ("api_key_missing", "error", "failed", "missing_api_key", "not_attempted", "rate_limited")
#: What an answer of status 429 says when more requests would be wasted.
STOP_MARKERS = ("insufficient budget", "rate limit", "too many requests")
ANCHOR_SHARE, QUALITY_SHARE = 0.6, 0.4


def match_text(c: str | Column) -> Column:
    """Text for pattern search: entities resolved, tags dropped, dashes alike, lower case, white space collapsed."""
    v = F.translate(F.regexp_replace(tx.unescape(tx.text(c)), "<[^>]+>", " "), tx.DASHES + " ", "-" * len(tx.DASHES) + " ")
    return tx.collapsed(F.lower(v))


def matched_patterns(d: DataFrame, text: str, patterns: tuple[str, ...], to: str = "matched") -> DataFrame:
    """Adds the patterns found in a text, in order. Hyphens and spaces are alike; a pattern of up to three letters or digits needs a boundary on both sides."""
    d = d.withColumn("__f", match_text(text)).withColumn("__g", F.replace("__f", F.lit("-"), F.lit(" ")))

    def found(pattern: str) -> Column:
        own, hit = " ".join(pattern.lower().split()), F.lit(False)
        for form in tx.unique([own, own.replace("-", " ")]):
            short = len(form) <= 3 and form.isascii() and form.isalnum()
            for where in ("__f", "__g"):
                hit = hit | (F.col(where).rlike(f"(?<![a-z0-9]){form}(?![a-z0-9])") if short else F.col(where).contains(form))
        return hit

    hits = [F.when(found(p), F.lit(p)) for p in tx.unique(list(patterns))]
    listed = F.filter(F.array(*hits), lambda v: v.isNotNull()) if hits else F.array().cast("array<string>")
    return d.withColumn(to, listed).drop("__f", "__g")


def retrieval_diagnostics(papers: DataFrame, k: int = 5) -> DataFrame:
    """Papers by provider and query, with the titles of the first k. The rank filter lets each task keep k rows of a query before the shuffle."""
    by = ["source_provider", "retrieval_query"]
    counts = papers.groupBy(*by).agg(F.count("*").alias("raw_count"))
    first = papers.select(*by, "input_ord", "title").withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("input_ord"))).filter(F.col("__n") <= k)
    titles = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "title"))), lambda x: x["title"]).alias("top_titles"))
    return counts.join(titles, by)


def lane_diagnostics(items: DataFrame, k: int = 20) -> DataFrame:
    """The first k papers of each question by lane: how many, which, and how many bear a false-positive penalty."""
    top = items.filter(F.col("rank") <= k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))), lambda x: x["paper_id"])
    return top.groupBy("question_id", "lane").agg(F.count("*").alias("n_papers"), F.count_if(F.col("false_positive_penalty") > 0).alias("n_penalised"), ids.alias("paper_ids"))


def query_quality(queries: DataFrame, query: str, axes: tuple[tuple[str, ...], ...], anchors: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: the share of anchor groups that some query names, distinct bad queries, and the score, a mix of the two at four decimals.

    A query is bad if one of its flags is set; with no query at all the second part counts in full.
    """
    d = query_flags(queries, query, axes).withColumn("__low", F.lower(tx.text(query)))
    hit = lambda terms: functools.reduce(Column.__or__, [F.col("__low").contains(t.lower()) for t in terms])
    named = [F.coalesce(F.bool_or(hit(terms)), F.lit(False)).cast("int") for terms in anchors.values()]
    bad = F.col("overbroad") | F.col("repeated") | F.col("single_axis")
    d = d.agg(F.count("*").alias("n_queries"), F.count_distinct(F.when(bad, F.col(query))).alias("n_bad"), (sum(named, F.lit(0)) / F.lit(float(max(1, len(named))))).alias("anchors"))
    share = F.when(F.col("n_queries") > 0, F.col("n_bad") / F.col("n_queries")).otherwise(0.0)
    return d.select("n_queries", "n_bad", F.round("anchors", 4).alias("anchor_coverage"), F.round(tx.clamp(ANCHOR_SHARE * F.col("anchors") + QUALITY_SHARE * (1 - share)), 4).alias("query_quality_score"))


def provider_rates(status: DataFrame) -> DataFrame:
    """Share of providers whose state is a success or at least not fatal, and how many failed; null without providers."""
    s = F.lower(F.trim(tx.text("status")))
    good = s.isin(*SUCCESS) | ((s != "") & ~s.isin(*FATAL))
    wrong = s.isin(*FATAL) | s.contains("error") | s.contains("failed")
    return status.agg(F.avg(good.cast("double")).alias("provider_success_rate"), F.when(F.count("*") > 0, F.count_if(wrong)).alias("provider_error_count"))


def before_stop(attempts: DataFrame, by: str = "provider", order: str = "attempt") -> DataFrame:
    """The attempts of each provider up to the first whose answer says that more would be wasted."""
    says = functools.reduce(Column.__or__, [F.lower(tx.text("error")).contains(m) for m in STOP_MARKERS])
    stop = attempts.filter((F.col("status_code") == 429) & says).groupBy(by).agg(F.min(order).alias("__stop"))
    return attempts.join(stop, by, "left").filter(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__stop")


def ordered_union(*sources: DataFrame) -> DataFrame:
    """The rows of all sources with the columns they share, in order of (source_ord, row_ord); each source brings its ``input_ord``."""
    shared = [c for c in sources[0].columns if all(c in s.columns for s in sources) and c != "input_ord"]
    parts = [s.select(*shared, F.lit(i).alias("source_ord"), F.col("input_ord").alias("row_ord")) for i, s in enumerate(sources)]
    return functools.reduce(DataFrame.unionByName, parts)


def next_searches(sources: list[DataFrame], limit: int = 12) -> DataFrame:
    """``pos, suggestion``: the first ``limit`` distinct suggestions, compared without case, in the order of the sources and of ``ord`` inside them."""
    parts = [s.select(F.lit(i).alias("s"), F.col("ord").cast("long").alias("o"), tx.collapsed("suggestion").alias("t")) for i, s in enumerate(sources)]
    d = functools.reduce(DataFrame.unionByName, parts).filter("t <> ''")
    first = d.groupBy(F.lower("t").alias("k")).agg(F.min(F.struct("s", "o", "t")).alias("x")).orderBy("x").limit(limit)
    return first.select(F.row_number().over(Window.orderBy("x")).alias("pos"), F.col("x.t").alias("suggestion"))


def repaired_queries(queries: DataFrame, suggestions: DataFrame) -> DataFrame:
    """``provider, query, pos``: planned queries with the suggestions for their exact text applied.

    A dropped query goes, one with a repaired text takes it, and repairs that no planned query received are appended; each text stands once
    per provider, compared without case. Of several suggestions for one query the last stands.
    """
    last = suggestions.groupBy("provider", F.col("original_query").alias("query")).agg(F.max_by(F.struct("recommendation", "repaired_query"), "ord").alias("x"))
    planned = queries.select("provider", "query", "ord").join(last, ["provider", "query"], "left").filter(F.coalesce(F.col("x.recommendation") != "drop", F.lit(True)))
    new = F.coalesce(F.nullif(F.col("x.repaired_query"), F.lit("")), F.col("query"))
    own = planned.select("provider", F.lit(0).alias("part"), "ord", new.alias("query"))
    more = suggestions.filter(F.col("recommendation") == "repair").select("provider", F.lit(1).alias("part"), "ord", F.col("repaired_query").alias("query"))
    d = own.union(more).withColumn("query", tx.collapsed("query")).filter("query <> ''")
    d = d.groupBy("provider", F.lower("query").alias("k")).agg(F.min(F.struct("part", "ord", "query")).alias("x"))
    return d.select("provider", "x.query", F.row_number().over(Window.partitionBy("provider").orderBy("x.part", "x.ord")).alias("pos"))


def last_by_id(papers: DataFrame, ids: DataFrame, order: str = "input_ord") -> DataFrame:
    """The last paper of each id that is asked for; ids without a paper go."""
    wanted = papers.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")
    cols = [c for c in papers.columns if c != "paper_id"]
    return wanted.groupBy("paper_id").agg(F.max_by(F.struct(*cols), order).alias("x")).select("paper_id", "x.*")


def kept_edges(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges whose target is still among the papers."""
    return edges.join(papers.select(F.col("paper_id").alias("dst_paper_id")).distinct(), "dst_paper_id", "left_semi")


def resolution_report(resolved: DataFrame) -> DataFrame:
    """How many seeds were resolved, and how many stay as the user gave them."""
    return resolved.agg(F.count("*").alias("seed_count"), F.count_if(F.col("source_stage") == "seed_exact").alias("resolved_count"), F.count_if(F.col("source_stage") != "seed_exact").alias("unresolved_count"))


def card_action(final: Column, aspect: Column, level: Column) -> Column:
    """What an evidence card suggests for a paper without a decision."""
    return F.when(level.isin("missing_abstract", "llm_invalid_evidence"), "uncertain").when((final >= 0.5) & (aspect >= 0.4), "include").when(final < 0.2, "exclude").otherwise("uncertain")


def paper_cards(items: DataFrame, limit: int = 12) -> DataFrame:
    """The evidence cards of the first papers as rows; a sink renders them."""
    cards = items.orderBy("rank").limit(limit)
    return cards.select(
        "rank", "paper_id", F.when(F.col("title") == "", "Untitled").otherwise(F.col("title")).alias("heading"), F.round("final", 3).alias("score"), "decision", "reading_priority", "suggested_action",
        card_action(F.col("final"), F.col("aspect_coverage_score"), F.col("support_level")).alias("card_action"), F.array_join("covered_aspects", ", ").alias("covered"), F.array_join("missing_aspects", ", ").alias("missing"),
    )


def without_fences(c: str | Column) -> Column:
    """A model's answer without the code fence around it."""
    v = F.trim(F.regexp_replace(tx.text(c), r"^\s+|\s+$", ""))
    inner = F.regexp_extract(v, r"(?s)^```(?:json|JSON)?\s*(.*?)\s*```$", 1)
    return F.when(v.rlike(r"(?s)^```(?:json|JSON)?\s*.*?\s*```$"), inner).otherwise(v)


def parsed_answer(d: DataFrame, answer: str) -> DataFrame:
    """Adds ``data`` (the JSON object as a variant, null if it is none) and ``error_type``: invalid_json, json_not_object or ''."""
    d = d.withColumn("__v", F.try_parse_json(without_fences(answer)))
    kind = F.schema_of_variant("__v")
    error = F.when(F.col("__v").isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "json_not_object").otherwise("")
    return d.withColumn("error_type", error).withColumn("data", F.when(F.col("error_type") == "", F.col("__v"))).drop("__v")
