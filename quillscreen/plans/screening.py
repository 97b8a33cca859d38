"""The screening plan: from papers and a contract to ranked, explained decisions.

Every per-paper step adds columns to the same row, so a paper is read and assessed once; the assessed papers are stored, and the shares of the roles
and the ranks are found from the few columns they need. The whole papers are shuffled once, by the number of their row, to meet their ranks, with the columns
that a query asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import best, matcher
from quillscreen.functions import scoring as sc
from quillscreen.functions import similarity as sim
from quillscreen.functions import text as tx
from quillscreen.operators import aspects, decisions, evidence, guardrail, ranking, roles
from quillscreen.operators.store import small, written
from quillscreen.plans.contract import Contract


def with_evidence(papers: DataFrame, question: str) -> DataFrame:
    """The papers with their best sentence, its overlap and its support; evidence of rule mode is a sentence of the abstract, so no join is needed."""
    d = papers.withColumn("__b", best.best_sentence(F.col("abstract"), question))
    words = len(set(tx.py_tokens(question)))
    overlap = F.coalesce(F.col("__b.hits") / F.lit(float(words)), F.lit(0.0)) if words else F.lit(0.0)
    level = F.when(tx.text("abstract") == "", "missing_abstract").when(F.col("__b.n") == 0, "missing_evidence").otherwise("strict_support")
    return d.withColumns({
        "evidence_sentence": F.coalesce("__b.sentence", F.lit("")), "claim": F.coalesce("__b.sentence", F.lit("")), "keyword_overlap": overlap, "sentence_no": F.col("__b.at"), "support_level": level,
        "supported": level == "strict_support", "no_abstract": tx.text("abstract") == "", "confidence": (level == "strict_support").cast("double"),
    }).drop("__b")


#: The texts of a paper whose words are counted, by the letter of their columns, and all of them together; a summary is part of the whole alone.
TEXTS, WHOLE = "taef", 4


def with_words(d: DataFrame, contract: Contract, stop_words: tuple[str, ...] = tx.STOPWORDS) -> DataFrame:
    """The papers with the lowered title, abstract, evidence and fields, and the counts of their words that relevance and aspects ask for: each text is lowered
    and split once. A space parts the texts where they are joined, so the words of the whole are those of its parts."""
    whole = F.concat_ws(" ", tx.text("claim"), tx.text("evidence_sentence"))
    d = d.withColumns({"__wlt": F.lower(tx.text("title")), "__wla": F.lower(tx.text("abstract")), "__wle": F.lower(whole), "__wlf": F.lower(tx.text(F.array_join("fields_of_study", " "))), "__wls": F.lower(tx.text("tldr") if "tldr" in d.columns else F.lit(""))})
    texts = [F.col(f"__wl{p}") for p in TEXTS] + ([F.col("__wls")] if "tldr" in d.columns else [])
    return d.withColumn("__w", sim.text_stats(texts, [*([i] for i in range(WHOLE)), list(range(len(texts)))], asked_words(contract, stop_words), stop_words))


def asked_words(contract: Contract, stop_words: tuple[str, ...]) -> list[str]:
    return sim.wanted_words([contract.question, fields_query(contract), *aspects.queries(contract.aspects)], stop_words)


def fields_query(contract: Contract) -> str:
    return " ".join([*contract.core_terms, *contract.must_terms, *contract.optional_terms])


def relevance(d: DataFrame, contract: Contract, stop_words: tuple[str, ...] = tx.STOPWORDS) -> DataFrame:
    """Adds the parts of hybrid relevance and ``hybrid_relevance``. Columns of with_words() are used if there are any, and dropped."""
    q = contract.question
    if "__w" not in d.columns:
        d = with_words(d, contract, stop_words)
    d = d.withColumn("__wlow", F.concat_ws(" ", "__wlt", "__wla", "__wle"))
    own, stats = [c for c in d.columns if c.startswith("__w")], sim.Stats("__w", asked_words(contract, stop_words))
    names = {"title_similarity": ("t", q), "abstract_similarity": ("a", q), "evidence_similarity": ("e", q), "field_match": ("f", fields_query(contract))}
    cosine = {name: sim.tfidf_cosine(query, None, stop_words, *stats.of(TEXTS.index(p))) for name, (p, query) in names.items()}
    groups = list(contract.must_term_groups) or [(t,) for t in contract.must_terms]
    hits, there = [F.lit(False) for _ in groups], matcher.Present("__wlow_p")
    for i, terms in enumerate(groups):
        for t in terms:
            hits[i] = hits[i] | there.has_tokens(t)
    if there.numbers:
        d = d.withColumn("__wlow_p", there.column(F.col("__wlow")))
        own.append("__wlow_p")
    must = sum((h.cast("int") for h in hits), F.lit(0)) / F.lit(float(len(groups))) if groups else F.lit(1.0)
    d = d.withColumns({**cosine, "api_relevance": sc.api_relevance(F.col("api_relevance_score")), "must_term_coverage": must})
    d = d.withColumn("hybrid_relevance", sc.hybrid({k: F.col(k) for k in sc.HYBRID}))
    return d.drop(*own)


def components(d: DataFrame, now_year: int, relevance_col: str = "hybrid_relevance") -> DataFrame:
    """Adds relevance (blended with aspect coverage if there is one), evidence, recency and quality."""
    rel = sc.with_aspects(F.col(relevance_col), F.col("aspect_coverage_score")) if "aspect_coverage_score" in d.columns else F.col(relevance_col)
    return d.withColumns({"relevance": rel, "evidence": sc.evidence(F.col("supported"), F.col("confidence"), F.col("keyword_overlap")), "recency": sc.recency(F.col("year"), now_year), "quality": sc.quality(F.col("citation_count"), F.col("venue"))})


def assess(papers: DataFrame, contract: Contract, now_year: int, use_guardrail: bool = True, use_aspects: bool = True) -> DataFrame:
    """The papers with all that is said about each on its own: evidence, aspects, guardrail and score parts, without a shuffle."""
    d = with_words(with_evidence(papers, contract.question), contract)
    if use_aspects:
        lowered = F.concat_ws(" ", "__wlt", "__wla", "__wls", "__wlf", "__wle")
        d = aspects.coverage(d, contract.aspects, keep=True, lowered=lowered, stats=sim.Stats("__w", asked_words(contract, tx.STOPWORDS)).of(WHOLE))
    else:
        d = d.withColumns({"covered_aspects": F.array().cast("array<string>"), "missing_aspects": F.array().cast("array<string>"), "aspect_coverage_score": F.lit(0.0)})
    d = components(relevance(d, contract), now_year)
    # The guardrail comes last: its columns are many and large, and the planner would write them out again in every step on top of them.
    if use_guardrail:
        d = guardrail.assess(d, contract, keep=True).withColumns({"centrality": F.col("intent_centrality_score"), "multiplier": sc.domain_multiplier(F.col("domain_decision"))})
    return d


def screen(papers: DataFrame, contract: Contract, now_year: int, profile: str = "balanced", use_guardrail: bool = True, use_aspects: bool = True) -> DataFrame:
    """Ranked papers with all assessments; switches turn the guardrail or the aspects off for ablations."""
    return ranking.rank(assess(papers, contract, now_year, use_guardrail, use_aspects), contract.weights or sc.weights(profile))


def classified(papers: DataFrame, role_rules) -> DataFrame:
    """The papers with their roles and primary role."""
    return roles.classify(papers, role_rules, into="__role").withColumns({c: F.col(f"__role.{c}") for c in ("roles", "primary_role")}).drop("__role")


def decide_ranked(ranked: DataFrame, contract: Contract) -> DataFrame:
    """The research adjustments and the decisions of ranked papers with their roles."""
    return decisions.decide(ranking.adjust(ranked, None, contract.seed_titles, contract.domain), keep=True)


def decide_stored(assessed: DataFrame, contract: Contract, profile: str = "balanced") -> DataFrame:
    """Shares of roles, ranks and decisions of papers that ``ranking.stored`` keeps."""
    marked = roles.mark_overbroad(assessed).drop("overbroad_roles")
    return decide_ranked(ranking.rank_stored(marked, contract.weights or sc.weights(profile)), contract).drop(ranking.ROW)


#: The texts of a paper. All else that is said about one takes a small part of their room.
LONG = ("title", "abstract", "claim", "evidence_sentence", "tldr")


def assessed_without_texts(papers: DataFrame, contract: Contract, now_year: int, role_rules=roles.GENERIC_RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """The stored assessments of the papers, with no more of their texts than ``keep`` names; what ranks and decisions ask of a text is a column by then."""
    d = ranking.boosted(assess(classified(papers, role_rules), contract, now_year), contract.seed_titles, contract.domain)
    return ranking.stored(d.drop(*[c for c in LONG if c not in keep]))


def screen_and_decide(papers: DataFrame, contract: Contract, now_year: int, profile: str = "balanced", role_rules=roles.GENERIC_RULES, texts: tuple[str, ...] | None = None) -> DataFrame:
    """screen(), the research adjustments, and the decisions, in one row per paper. With ``texts`` the rows have only these of a paper's texts, and no other is stored."""
    if texts is None:
        return decide_stored(ranking.stored(assess(classified(papers, role_rules), contract, now_year)), contract, profile)
    return decide_stored(assessed_without_texts(papers, contract, now_year, role_rules, texts), contract, profile)


def decided_texts(papers: DataFrame, contract: Contract, now_year: int, decision: str, texts: tuple[str, ...], profile: str = "balanced", role_rules=roles.GENERIC_RULES) -> DataFrame:
    """``decision`` and the texts of the papers that got it. The texts are read once the papers are known, so no others are shuffled or read again."""
    kept = assessed_without_texts(papers, contract, now_year, role_rules, texts)
    marked = roles.mark_overbroad(kept.drop(*texts)).drop("overbroad_roles")
    d = decide_ranked(ranking.rank_stored(marked, contract.weights or sc.weights(profile)), contract)
    found = written(d.filter(F.col("decision") == decision).select(ranking.ROW, "decision"))
    return kept.select(ranking.ROW, *texts).join(small(found), ranking.ROW).drop(ranking.ROW)


def flagship(papers: DataFrame, question: str, now_year: int, k: int = 20) -> DataFrame:
    """The k best papers for a question with their best sentence: overlap, evidence, recency, quality and venue diversity, no control plane."""
    d = with_evidence(papers, question)
    d = components(d.withColumn("overlap", tx.overlap(tx.tokens(F.concat_ws(" ", "title", "abstract", "claim", "evidence_sentence")), question)), now_year, "overlap")
    ranked = ranking.rank(d.drop("source_stage"))
    out = ["rank", "paper_id", "evidence_sentence", "keyword_overlap", "relevance", "evidence", "recency", "quality", "diversity", "final"]
    return ranked.filter(F.col("rank") <= k).select(*out)


def evidence_tables(papers: DataFrame, question: str) -> tuple[DataFrame, DataFrame]:
    """The evidence and verification tables of a run."""
    e = evidence.best_sentence(papers, question)
    return e, evidence.exact_verification(e, papers)
