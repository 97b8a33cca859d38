"""Anchor hits of queries, and the gate that keeps or drops a query with its reason.

Anchors are found by a T-occurrence join: the tokens of the distinct query texts meet an inverted index from tokens to anchors, and the shared
tokens of each (text, anchor) pair are counted. All tokens of an anchor make a full hit, two a loose one if the anchor has more than two.
Anchors inside words or across them, which share no token, come from one automaton pass over the text (``functions.matcher``) and are full hits.
Only texts that differ are counted, so a query that many rows repeat is joined once.

Defined cases: a null query is the empty one; repeated rows and repeated ids each get their verdict; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import matcher
from quillscreen.functions import text as tx
from quillscreen.operators.store import exploded, join_aggregate, small, written
from quillscreen.plans.contract import Group

Terms = tuple[str, ...]
CORE, SECONDARY, NEED, GROUP = "core", "secondary", "need", "group"
#: Tokens and hits of distinct texts whose pairs with the terms one task counts.
TOKENS = 100_000

#: Terms that are a need or an aspect as a whole, what marks a term as one, and what makes it an object again.
NEEDS = (
    "in situ", "ex situ", "operando", "post mortem", "failure mechanism", "theoretical mechanism", "experimental characterization", "characterization", "comparison",
    "advantages disadvantages", "review", "background",
)
NEED_MARKS = ("characterization", "mechanism", "measurement", "importance", "significance")
OBJECT_MARKS = ("reaction", "interface", "cell", "screening", "deposition", "capture", "passivation")
#: Terms that anchor nothing, and words that make a short query broad.
EMPTY_TERMS = ("importance", "significance", "background", "review")
BROAD_WORDS = ("review", "background", "comparison", "characterization", "mechanism", "battery", "thin", "film", "carbon", "dioxide")
GROUP_MARKS = ("context", "process", "property")
#: Fixed values of the critic: words of a topic, and of queries on it.
AI_TOPIC, AI_POLLUTION = ("llm", "systematic review", "literature screening"), ("representative material", "experimental characterization", "materials")
CAPTURE_TOPIC = ("co2", "carbon dioxide", "capture", "adsorption")
CAPTURE_CONTEXT = ("co2", "carbon dioxide", "carbon capture", "co2 capture", "co2 adsorption", "adsorption")
CAPTURE_ASPECTS = ("pore", "functional", "water stability", "adsorption performance", "structure property", "review", "framework", "case stud")
FILM_TOPIC, FILM_TOPIC_ALSO = ("thin film deposition", "atomic layer deposition", "sputtering"), ("thin film", "atomic layer deposition")
FILM_METHODS = ("ald", "atomic layer deposition", "pld", "pulsed laser deposition", "sputtering", "cvd", "chemical vapor deposition")
FILM_ANCHORS = ("thin film", "deposition", "fabrication", "physical vapor deposition", "chemical vapor deposition")
COMPARISON = ("comparison", "review", "advantages", "disadvantages", "pros cons", "techniques", "methods")
#: Fixed values of the three tests for a query of one acronym.
LONE_WORDS, CRITIC_ACRONYMS = ("review", "mechanism", "method"), ("sei", "oer", "mof", "lib", "lmb", "orr", "aem", "lom", "co2", "ai")
TOOL_ACRONYM = r'(?i)^\+?"?(AI|LLM|MOF|OER|PFM|SEI|SHG)"?$'


@dataclass(frozen=True)
class Frame:
    """The terms of a question by their part in it."""

    research_object: Terms = ()
    core_terms: Terms = ()
    domain_context: Terms = ()
    target_process_or_property: Terms = ()
    material_or_case_terms: Terms = ()
    application_or_metric_terms: Terms = ()
    failure_or_limitation_terms: Terms = ()
    controversy_terms: Terms = ()
    method_terms: Terms = ()
    mechanism_terms: Terms = ()
    relation_or_effect: Terms = ()
    downweighted_terms: Terms = ()

    def text_of(self, *parts: str) -> str:
        return plain(" ".join(t for p in parts for t in getattr(self, p)))

    def anchors(self) -> dict[str, list[str]]:
        """Core, secondary and need terms; a core term is not secondary as well."""
        parts = {CORE: ("research_object", "core_terms"), NEED: ("method_terms", "mechanism_terms", "relation_or_effect", "downweighted_terms")}
        parts[SECONDARY] = tuple(f.name for f in fields(self) if f.name not in (*parts[CORE], *parts[NEED]))
        found = {kind: candidates([t for p in names for t in getattr(self, p)], kind == CORE) for kind, names in parts.items()}
        core = set(map(plain, found[CORE]))
        return found | {SECONDARY: [t for t in found[SECONDARY] if plain(t) not in core]}


def plain(value: str) -> str:
    """A query or term in lower case without quotes, plus signs and brackets."""
    return " ".join(value.lower().translate(str.maketrans('"+()', "    ")).split())


def plain_column(query: str | Column) -> Column:
    return tx.collapsed(F.translate(F.lower(tx.text(query)), '"+()', "    "))


def is_need(term: str) -> bool:
    """A term that names a need or an aspect rather than an object."""
    low = plain(term)
    return low in NEEDS or (any(m in low for m in NEED_MARKS) and not any(m in low for m in OBJECT_MARKS))


def candidates(terms: Sequence[str], no_needs: bool = False) -> list[str]:
    """The terms that can anchor a query, first occurrences."""
    return [t for t in tx.unique(list(terms)) if t.lower() not in EMPTY_TERMS and not (no_needs and is_need(t))]


def required_anchor_groups(groups: Sequence[Group]) -> list[tuple[str, list[str]]]:
    """Required groups of a context, process or property that have a term."""
    named = [(g.name, candidates(g.terms)) for g in groups if g.required and any(m in g.name.lower() for m in GROUP_MARKS)]
    return [(name, terms) for name, terms in named if terms]


# ---- queries of one acronym ------------------------------------------------------------------------------------------


def lone_word(query: str | Column) -> Column:
    """The generator's test: one word without operators that is all capitals, or short and not a word of aspects."""
    kept = F.regexp_replace(F.regexp_replace(tx.text(query), r'[+"()]', " "), r"(?i)\b(AND|OR|NOT)\b", " ")
    words = F.filter(F.split(kept, r"\s+"), lambda w: w != "")
    word = F.get(words, F.lit(0))
    # A short word that is no aspect passes whatever its case, so only long or aspect words need the test of capitals.
    capitals = (F.upper(word) == word) & word.rlike(r"^[A-Z0-9][A-Z0-9\-]{1,8}$")
    return F.coalesce((F.size(words) == 1) & ((F.length(word) <= 1) | capitals | ((F.length(word) <= 12) & ~F.lower(word).isin(*LONE_WORDS))), F.lit(False))


def lone_acronym(query: str | Column) -> Column:
    """The critic's test: one distinct word without operators that is a known acronym, or any two to six capitals or digits beside it."""
    raw = F.regexp_extract_all(F.translate(tx.text(query), "\"'+", "   "), F.lit("[A-Za-z0-9]+"), F.lit(0))
    words = F.array_distinct(F.filter(F.transform(raw, F.lower), lambda w: ~w.isin("and", "or", "not")))
    shouted = F.exists(raw, lambda w: (F.upper(w) == w) & F.length(w).between(2, 6))
    return F.coalesce((F.size(words) == 1) & (F.get(words, F.lit(0)).isin(*CRITIC_ACRONYMS) | shouted), F.lit(False))


def listed_acronym(query: str | Column) -> Column:
    """The evaluation's test: one of seven acronyms, with a plus sign or quotes around it at most."""
    return tx.text(query).rlike(TOOL_ACRONYM)


# ---- hits ------------------------------------------------------------------------------------------------------------


def text_key(text: str | Column) -> Column:
    """What stands for a text in all rows about it, so that no shuffle repeats the text itself."""
    return F.md5(tx.text(text))


def anchor_hits(texts: DataFrame, terms: Sequence[str], text_col: str = "text") -> DataFrame:
    """``key, anchor, shared, full``: one row per pair of a distinct plain text and a term that meet, with the tokens they share.

    ``key`` is the text's ``text_key`` and ``anchor`` the number of the term. ``full`` says that the text holds the term or all its tokens; other rows
    share at least two tokens with a term of more. One shuffle finds the distinct texts by their keys, whose tokens and hits are stored; another deals them out so
    that no task holds the pairs of more than about ``TOKENS`` of them, and the pairs are counted where they lie.
    """
    cleaned = [plain(t) for t in terms]
    token_sets = [sorted(set(tx.py_tokens(t))) for t in cleaned]
    index = texts.sparkSession.createDataFrame([(w, i, len(ws)) for i, ws in enumerate(token_sets) for w in ws], "token string, indexed int, n int")
    known = sorted({w for ws in token_sets for w in ws})
    # Only what can meet a term is shuffled to find the distinct texts, not the texts.
    own = F.array_intersect(tx.tokens("text"), F.array(*[F.lit(w) for w in known])) if known else F.array().cast("array<string>")
    d = texts.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")).withColumn("h", matcher.first_hits(F.col("text"), cleaned))
    d = written(d.select("key", own.alias("own"), F.col("h.term").alias("h")).dropDuplicates(["key"]))
    # A task counts the pairs of so many tokens, however long the table: fixed shares of the texts would grow with it.
    n = d.agg(F.sum((F.size("own") + F.size("h")).cast("long"))).first()[0] or 0
    d = d.repartition(max(1, -(-n // TOKENS)), "key")
    shared = F.transform("own", lambda t: F.struct(t.alias("token"), F.lit(None).cast("int").alias("inside")))
    inside = F.transform("h", lambda t: F.struct(F.lit(None).cast("string").alias("token"), t.alias("inside")))
    met = exploded(d, F.concat(shared, inside), "m", "key").select("key", "m.token", "m.inside").join(small(index), "token", "left")
    met = met.withColumn("anchor", F.coalesce("inside", "indexed")).filter("anchor IS NOT NULL")
    counted = met.groupBy("key", "anchor").agg(F.count("indexed").cast("int").alias("shared"), F.max("n").alias("n"), F.count_if(F.col("inside").isNotNull()).alias("inside"))
    full = (F.col("inside") > 0) | F.coalesce(F.col("shared") == F.col("n"), F.lit(False))
    return counted.select("key", "anchor", "shared", full.alias("full"), "n").filter(F.col("full") | ((F.col("n") > 2) & (F.col("shared") >= 2))).drop("n")


def hit_counts(texts: DataFrame, anchors: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """One row per ``key`` of a text with any hit: ``any_<kind>`` and ``full_<kind>``, the numbers of distinct terms of each kind with a hit and with a full one."""
    terms = [(kind, t) for kind, ts in anchors.items() for t in {plain(t): t for t in ts}.values() if plain(t)]
    found = anchor_hits(texts, [t for _, t in terms], text_col)
    of = {kind: [i for i, (k, _) in enumerate(terms) if k == kind] for kind in anchors}
    within = lambda kind: F.col("anchor").isin(of[kind]) if of[kind] else F.lit(False)
    each = [c for kind in anchors for c in (F.count_if(within(kind)).alias(f"any_{kind}"), F.count_if(within(kind) & F.col("full")).alias(f"full_{kind}"))]
    return found.groupBy("key").agg(*each)


# ---- the gate --------------------------------------------------------------------------------------------------------


def _holds(low: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _number(low: Column, words: Sequence[str]) -> Column:
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def _first(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    out = otherwise
    for when, value in reversed(rules):
        out = F.when(when, value).otherwise(out)
    return out


def critic_issue(low: Column, frame: Frame) -> Column:
    """What is wrong with a plain query on the three topics that have templates of their own; '' where nothing is."""
    topic = frame.text_of("research_object", "domain_context", "target_process_or_property", "method_terms", "application_or_metric_terms")
    about = lambda words: any(w in topic for w in words)
    words = tx.tokens(low)
    rules: list[tuple[Column, str]] = []
    if about(AI_TOPIC):
        rules.append((_holds(low, AI_POLLUTION), "cross_domain_pollution:ai_screening_material_template_terms"))
    if "mof" in topic and about(CAPTURE_TOPIC):
        mof = F.array_contains(words, "mof") | low.contains("metal organic framework")
        rules += [
            (low.contains("representative materials"), "cross_domain_pollution:mof_representative_materials_template"),
            (mof & (F.size(words) <= 3), "overbroad_queries:mof_short_anchor_only"),
            (mof & ~_holds(low, CAPTURE_CONTEXT), "overbroad_queries:mof_missing_co2_adsorption_context"),
            (mof & ~_holds(low, CAPTURE_ASPECTS) & (F.size(words) <= 4), "overbroad_queries:mof_missing_aspect_or_review_intent"),
        ]
    if about(FILM_TOPIC):
        methods, compares = _number(low, FILM_METHODS), _holds(low, COMPARISON)
        rules += [
            ((low.contains("atomic layer deposition") | F.array_contains(words, "ald")) & (methods < 3), "diversity_suggestions:thin_film_ald_bias"),
            ((methods >= 2) & ~compares & ~low.contains("thin film"), "diversity_suggestions:thin_film_missing_comparison_intent"),
            ((methods < 2) & ~compares, "overbroad_queries:thin_film_single_method_query"),
            (~_holds(low, FILM_ANCHORS) & ~compares, "overbroad_queries:thin_film_missing_method_comparison_anchor"),
        ]
    return _first([(when, F.lit(issue)) for when, issue in rules], F.lit(""))


def compares_films(low: Column, frame: Frame) -> Column:
    """A query that compares methods of thin films, where the topic is thin films."""
    topic = frame.text_of("research_object", "domain_context", "method_terms")
    if not any(w in topic for w in FILM_TOPIC_ALSO):
        return F.lit(False)
    return _holds(low, ("thin film", "deposition", "fabrication")) & (_holds(low, COMPARISON) | (_number(low, (*FILM_METHODS, "physical vapor deposition")) >= 4))


def looks_broad(low: Column) -> Column:
    """At most two words, or at most four with a broad one."""
    words = tx.tokens(low)
    return (F.size(words) <= 2) | ((F.size(words) <= 4) & F.arrays_overlap(words, F.array(*[F.lit(w) for w in BROAD_WORDS])))


def gate(queries: DataFrame, frame: Frame | None, groups: Sequence[Group] = (), query_col: str = "query", source_col: str = "source") -> DataFrame:
    """``queries`` with ``keep, reason, critic_issue, missing_groups``: the first of thirteen outcomes that holds.

    Without a frame only blank queries and lone words are dropped. Queries of the source ``seed_context`` are kept as they are.
    """
    written, source = tx.collapsed(query_col), tx.text(source_col)
    none = F.array().cast("array<string>")
    early = [(written == "", "empty_query"), (source == "seed_context", "seed_context"), (lone_word(written), "single_acronym_only_query")]
    kept = ("seed_context", "no_generic_frame_available", "thin_film_method_comparison_anchor_passed", "anchor_rule_passed")
    if frame is None:
        reason = _first([(when, F.lit(name)) for when, name in early], F.lit("no_generic_frame_available"))
        return queries.withColumns({"keep": reason.isin(*kept), "reason": reason, "critic_issue": F.lit(""), "missing_groups": none})
    required = required_anchor_groups(groups)
    anchors = frame.anchors() | {f"{GROUP}{i}": terms for i, (_, terms) in enumerate(required)}
    low = F.col("__plain")
    d = queries.withColumn("__plain", plain_column(query_col)).withColumn("__key", text_key("__plain"))
    found = hit_counts(d.select("__plain"), anchors, "__plain")
    d = join_aggregate(d, found.withColumnsRenamed({c: f"__{c}" for c in found.columns}), ["__key"], "left")
    n = lambda kind, how="any": F.coalesce(F.col(f"__{how}_{kind}"), F.lit(0))
    missing = F.filter(F.array(*[F.when(n(f"{GROUP}{i}") == 0, F.lit(name)) for i, (name, _) in enumerate(required)]), lambda v: v.isNotNull()) if required else none
    core, second = bool(anchors[CORE]), bool(anchors[SECONDARY])
    issue = critic_issue(low, frame)
    rules = [
        *early, (issue != "", "accepted_rule_query_critic_issue"), (F.size(missing) > 0, "missing_required_context_or_process_anchor"),
        ((n(NEED) > 0) & (n(CORE) == 0), "method_or_need_only_query"), (F.lit(core) & (n(CORE) == 0), "missing_core_object_anchor"),
        (F.lit(second) & (n(SECONDARY) == 0), "missing_context_or_process_anchor"), (compares_films(low, frame), "thin_film_method_comparison_anchor_passed"),
        (F.lit(not second) & (n(CORE, "full") < 2) & (n(NEED) == 0), "missing_second_anchor"), (F.lit(not second) & looks_broad(low), "broad_standalone_query"),
    ]
    d = d.withColumn("reason", _first([(when, F.lit(name)) for when, name in rules], F.lit("anchor_rule_passed")))
    told = lambda reason, value, other: F.when(F.col("reason") == reason, value).otherwise(other)
    d = d.withColumns({"keep": F.col("reason").isin(*kept), "critic_issue": told("accepted_rule_query_critic_issue", issue, F.lit("")), "missing_groups": told("missing_required_context_or_process_anchor", missing, none)})
    return d.drop("__plain", *[f"__{c}" for c in found.columns])
