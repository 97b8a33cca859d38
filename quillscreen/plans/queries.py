"""The example queries, one or more per operator, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.functions import scoring as sc
from quillscreen.functions import similarity as sim
from quillscreen.functions import text as tx
from quillscreen.operators import aspects, decisions, dedup, evidence, gaps, guardrail, metrics, preference, provenance, ranking, reading, roles, snowball
from quillscreen.operators.store import checkpointed
from quillscreen.plans import oracle as o
from quillscreen.plans import papers as pp
from quillscreen.plans import screening
from quillscreen.plans.papers import CONTRACT, NOW_YEAR, QUESTION, ROLE_RULES, papers, sql_collapsed, sql_overlap, sql_title_key, sql_tokens

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: Results that both engines round to six decimals, as sums in another order differ in the last bits.
FLOATS = {
    "flagship_screen": ("keyword_overlap", "relevance", "evidence", "recency", "quality", "diversity", "final",),
    "tokenize_overlap": ("overlap",),
    "best_sentence": ("keyword_overlap",),
    "tfidf_cosine": ("title_similarity", "abstract_similarity", "evidence_similarity", "field_match",),
    "hybrid_relevance": ("api_relevance", "must_term_coverage", "hybrid_relevance",),
    "score_components": ("evidence", "recency", "quality",),
    "ranking_profiles": ("score",),
    "venue_diversity_rank": ("diversity", "final0", "final",),
    "dedup_merge_exact": ("api_relevance_score",),
    "completeness": ("completeness",),
    "group_coverage_guardrail": ("domain_match_score", "intent_centrality_score", "required_group_coverage_score", "topic_focus_score",),
    "aspect_coverage": ("aspect_coverage_score",),
    "role_multilabel": ("confidence",),
    "full_rank": ("relevance", "diversity", "multiplier", "centrality", "final",),
    "ranking_adjustments": ("role_adjustment", "lane_adjustment", "seed_boost", "false_positive_penalty", "final",),
    "screening_decision": ("decision_confidence",),
    "support_summary": ("missing_abstract_ratio", "unsupported_claim_rate", "grounding_accuracy", "strict_support_rate", "weak_support_rate",),
    "feedback_rerank": ("final",),
    "rank_shift": ("mean_abs_rank_delta",),
    "ir_metrics": ("precision_at_k", "ndcg_at_k", "recall_at_k", "average_precision",),
    "preference_terms": ("preference_score",),
    "anchor_coverage": ("anchor_coverage",),
    "ablation_delta": ("delta_n_events", "delta_total",),
    "pilot_results": ("off_topic_rate_estimate",),
    "snowball_one_hop": ("seed_confidence",),
    "research_tensions": ("confidence",),
    "exploration_quality": ("evidence_grounding_ratio", "in_scope_ratio", "role_assigned_ratio", "target_role_coverage",),
}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        name, floats = f.__name__, FLOATS.get(f.__name__, ())

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(c, 6) for c in floats}) if floats else f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in floats)}) FROM ({sql})" if floats else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decided(spark: SparkSession, sf_dir: str, *texts: str, also=lambda p: p) -> DataFrame:
    """The decided papers with those of their texts that a query reads; ``also`` adds to each paper what is found in all of them."""
    return screening.screen_and_decide(also(papers(spark, sf_dir)), CONTRACT, NOW_YEAR, role_rules=ROLE_RULES, texts=texts)


FROM_PAPERS = o.with_(pp.PAPERS)
SIMPLE = o.with_(pp.PAPERS, o.EVIDENCE, o.SIMPLE_SCORED, o.ranked(o.weighted(), floor=False))

# ---- text, evidence and scores ------------------------------------------------------------------------------------------


@query(SIMPLE + "SELECT rank, paper_id, evidence_sentence, keyword_overlap, relevance, evidence, recency, quality, diversity, final FROM ranked WHERE rank <= 20")
def flagship_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best papers for the question."""
    return screening.flagship(papers(spark, sf_dir), QUESTION, NOW_YEAR)


@query(FROM_PAPERS + f"SELECT paper_id, len({sql_tokens('abstract')}) AS n_tokens, {sql_overlap(sql_tokens('abstract'))} AS overlap, array_to_string(list_sort(list_intersect(list_distinct({sql_tokens('abstract')}), [{pp.quoted(sorted(set(tx.py_tokens(QUESTION))))}])), ' ') AS shared FROM papers")
def tokenize_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and their overlap with the question."""
    d = papers(spark, sf_dir).withColumn("t", tx.tokens("abstract"))
    return d.select("paper_id", F.size("t").cast("long").alias("n_tokens"), tx.overlap(F.col("t"), QUESTION).alias("overlap"), F.array_join(tx.overlap_terms(F.col("t"), QUESTION), " ").alias("shared"))


@query(o.with_(pp.PAPERS, o.EVIDENCE) + "SELECT paper_id, evidence_sentence, keyword_overlap, support_level FROM ev")
def best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best sentence and its verification, joined."""
    e, v = screening.evidence_tables(papers(spark, sf_dir), QUESTION)
    return e.join(v, "paper_id").select("paper_id", "evidence_sentence", "keyword_overlap", "support_level")


@query()
def fuzzy_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark passage as external evidence for every document, with the similarity branch."""
    p = papers(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), F.col("text").alias("evidence_sentence"), F.lit(False).alias("llm_used"))
    e = b.join(p.select("paper_id", F.pmod("input_ord", F.lit(max(1, b.count()))).alias("n")), "n").select("paper_id", "evidence_sentence", "llm_used")
    return evidence.verify(e, p)


@query(o.with_(pp.PAPERS, o.EVIDENCE) + f"SELECT paper_id, {o.EVIDENCE_FN} AS evidence_function FROM (SELECT paper_id, lower(evidence_sentence || ' ' || title || ' ' || abstract) AS low FROM ev)")
def evidence_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence contributes."""
    d = screening.with_evidence(papers(spark, sf_dir), QUESTION)
    return d.select("paper_id", evidence.evidence_function("evidence_sentence", "title", "abstract").alias("evidence_function"))


@query(FROM_PAPERS + f"SELECT paper_id, {sql_title_key('title')} AS title_key, regexp_replace(lower(trim(doi)), '^\\.+|\\.+$', '', 'g') AS doi_key FROM papers")
def title_doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys of titles and DOIs; the DOIs come in URL form and upper case."""
    d = papers(spark, sf_dir)
    doi = F.when(F.col("doi") != "", F.concat(F.lit(" HTTPS://dx.doi.org/"), "doi", F.lit("."))).otherwise("")
    return d.select("paper_id", tx.title_key("title").alias("title_key"), tx.doi_key(F.lower(doi)).alias("doi_key"))


@query(FROM_PAPERS + "SELECT paper_id, substr(sha1(array_to_string(list_filter([lower(trim(doi)), lower(trim(title))], lambda v: v <> ''), '||')), 1, 16) AS stable_id FROM papers WHERE title <> ''")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.4: ids from the parts of a record."""
    return papers(spark, sf_dir).filter("title <> ''").select("paper_id", tx.stable_id("doi", "title").alias("stable_id"))


@query(o.with_(pp.PAPERS, o.EVIDENCE, o.WORDS, o.SIMILAR) + "SELECT paper_id, title_similarity, abstract_similarity, evidence_similarity, field_match FROM hybrid")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-document TF-IDF cosines in closed form."""
    d = screening.relevance(screening.with_evidence(papers(spark, sf_dir), QUESTION), CONTRACT)
    return d.select("paper_id", "title_similarity", "abstract_similarity", "evidence_similarity", "field_match")


@query(o.with_(pp.PAPERS, o.EVIDENCE, o.WORDS, o.SIMILAR) + "SELECT paper_id, api_relevance, must_term_coverage, hybrid_relevance FROM hybrid")
def hybrid_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid relevance."""
    return screening.relevance(screening.with_evidence(papers(spark, sf_dir), QUESTION), CONTRACT).select("paper_id", "api_relevance", "must_term_coverage", "hybrid_relevance")


@query(o.with_(pp.PAPERS, o.EVIDENCE) + f"SELECT paper_id, {o.EVIDENCE_SCORE} AS evidence, {o.RECENCY} AS recency, {o.QUALITY} AS quality FROM ev")
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, recency and quality."""
    d = screening.with_evidence(papers(spark, sf_dir), QUESTION).withColumn("z", F.lit(0.0))
    return screening.components(d, NOW_YEAR, "z").select("paper_id", "evidence", "recency", "quality")


@query(o.with_(pp.PAPERS, o.EVIDENCE, o.SIMPLE_SCORED) + " UNION ALL ".join(f"SELECT paper_id, '{p}' AS profile, {o.weighted(p)} AS score FROM (SELECT *, 0.5 AS diversity FROM scored)" for p in sc.PROFILES))
def ranking_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base score under each of the profiles, from one pass over the papers."""
    d = screening.with_evidence(papers(spark, sf_dir), QUESTION)
    d = screening.components(d.withColumn("o", tx.overlap(tx.tokens(F.concat_ws(" ", "title", "abstract", "claim", "evidence_sentence")), QUESTION)), NOW_YEAR, "o")
    parts = lambda p: sc.Inputs(F.col("relevance"), F.col("evidence"), F.col("recency"), F.col("quality"), F.lit(0.5), weights=sc.weights(p))
    each = F.array(*[F.struct(F.lit(p).alias("profile"), sc.final_score(parts(p)).alias("score")) for p in sc.PROFILES])
    return d.select("paper_id", F.explode(each).alias("s")).select("paper_id", "s.profile", "s.score")


@query(SIMPLE + "SELECT paper_id, rank, diversity, final0, final FROM ranked")
def venue_diversity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass rank of all papers."""
    d = screening.with_evidence(papers(spark, sf_dir), QUESTION)
    d = screening.components(d.withColumn("o", tx.overlap(tx.tokens(F.concat_ws(" ", "title", "abstract", "claim", "evidence_sentence")), QUESTION)), NOW_YEAR, "o")
    return ranking.rank(d.drop("source_stage")).select("paper_id", "rank", "diversity", "final0", "final")


@query(SIMPLE + "SELECT paper_id, rank FROM ranked")
def rank_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 for a question with most of the rows: the same ranks from a range shuffle."""
    d = screening.with_evidence(papers(spark, sf_dir), QUESTION)
    d = screening.components(d.withColumn("o", tx.overlap(tx.tokens(F.concat_ws(" ", "title", "abstract", "claim", "evidence_sentence")), QUESTION)), NOW_YEAR, "o")
    r = ranking.rank(d.drop("source_stage")).select("question_id", "paper_id", "final", F.struct((-F.col("final0")).alias("a"), "input_ord").alias("tie"))
    return ranking.rank_in_blocks(r, "final", "tie").select("paper_id", "rank")


# ---- filters, dedup ------------------------------------------------------------------------------------------------------


@query(FROM_PAPERS + "SELECT count(*) AS before_count, count(*) FILTER (WHERE source_stage <> 'keyword' OR year >= 2015) AS after_count, count(*) FILTER (WHERE source_stage = 'keyword' AND year IS NULL) AS dropped_missing_year, count(*) FILTER (WHERE source_stage = 'keyword' AND year < 2015) AS dropped_too_old, count(*) FILTER (WHERE source_stage <> 'keyword' AND (year IS NULL OR year < 2015)) AS kept_seed_exempt FROM papers")
def year_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit of the hard year filter with its seed exemption."""
    return provenance.year_filter_audit(papers(spark, sf_dir), 2015)


@query(FROM_PAPERS + "SELECT paper_id, year FROM papers WHERE source_stage <> 'keyword' OR year >= 2015")
def year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the papers that stay."""
    return provenance.year_filter(papers(spark, sf_dir), 2015).select("paper_id", "year")


@query(FROM_PAPERS + f"SELECT min(input_ord) AS gid, count(*) AS n_records FROM (SELECT input_ord, CASE WHEN doi <> '' THEN 'd:' || doi WHEN {sql_title_key('title')} <> '' THEN 't:' || {sql_title_key('title')} ELSE 'o:' || input_ord END AS k FROM papers) GROUP BY k")
def exact_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, fast form: groups by DOI, else title."""
    return dedup.exact_key_groups(papers(spark, sf_dir)).select("gid", "n_records")


_COMPLETE = "CASE WHEN title <> '' THEN 2.0 ELSE 0.0 END + least(length(abstract) / 500.0, 3.0) + CASE WHEN doi <> '' THEN 1.0 ELSE 0.0 END + CASE WHEN venue <> '' THEN 0.5 ELSE 0.0 END + CASE WHEN coalesce(year, 0) <> 0 THEN 0.5 ELSE 0.0 END + least(citation_count / 100.0, 1.0)"


@query(
    FROM_PAPERS
    + f""", k AS (SELECT *, CASE WHEN doi <> '' THEN 'd:' || doi WHEN {sql_title_key('title')} <> '' THEN 't:' || {sql_title_key('title')} ELSE 'o:' || input_ord END AS k, {_COMPLETE} AS full_ FROM papers)
    SELECT arg_min(paper_id, o) AS paper_id, arg_min(title, o) AS title, coalesce(arg_min(abstract, o) FILTER (WHERE abstract <> ''), '') AS abstract, arg_min(year, o) FILTER (WHERE coalesce(year, 0) <> 0) AS year,
    coalesce(arg_min(venue, o) FILTER (WHERE venue <> ''), '') AS venue, max(citation_count) AS citation_count, max(api_relevance_score) AS api_relevance_score, count(*) AS n_records,
    CASE WHEN bool_or(source_stage = 'manual_seed') THEN 'manual_seed' WHEN bool_or(source_stage = 'seed_exact') THEN 'seed_exact' ELSE 'keyword' END AS source_stage,
    array_to_string(list_sort(list_distinct(list(source_provider))), ';') AS source_provider FROM (SELECT *, (-full_, input_ord) AS o FROM k) GROUP BY k"""
)
def dedup_merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: the field-by-field merge of groups by DOI, else title."""
    p = papers(spark, sf_dir)
    d = dedup.keyed(p)
    key = F.when(F.col("doi_key") != "", F.concat(F.lit("d:"), "doi_key")).when(F.col("title_key") != "", F.concat(F.lit("t:"), "title_key")).otherwise(F.concat(F.lit("o:"), F.col("input_ord").cast("string")))
    m = dedup.merge_groups(d.withColumn("gid", key).select(*p.columns, "gid"))
    return m.select("paper_id", "title", "abstract", "year", "venue", "citation_count", "api_relevance_score", "n_records", "source_stage", "source_provider")


@query()
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, exact form: the ordered fold inside components of equal keys."""
    return dedup.deduplicate(papers(spark, sf_dir)).select("input_ord", "paper_id", "n_records", "title", "year", "doi", "citation_count", "source_stage")


@query(FROM_PAPERS + f"SELECT paper_id, {_COMPLETE} AS completeness FROM papers")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: completeness of each record."""
    p = papers(spark, sf_dir)
    return p.select("paper_id", dedup.completeness(p).alias("completeness"))


# ---- scope, aspects, roles ----------------------------------------------------------------------------------------------


@query(o.with_(pp.PAPERS, o.GUARD) + "SELECT paper_id, domain_match_score, domain_decision, intent_centrality_score, required_group_coverage_score, topic_focus_score, missing_required_group_count, peripheral_context_reason, positive_matches, negative_matches, forbidden_found, off_topic_reason FROM guard")
def group_coverage_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope of each paper under the contract, with negation, and the reason."""
    g = guardrail.assess(papers(spark, sf_dir), CONTRACT)
    j = lambda c: F.array_join(c, ";")
    return g.select("paper_id", "domain_match_score", "domain_decision", "intent_centrality_score", "required_group_coverage_score", "topic_focus_score", "missing_required_group_count", "peripheral_context_reason", j("positive_domain_matches").alias("positive_matches"), j("negative_domain_matches").alias("negative_matches"), j("forbidden_concepts_found").alias("forbidden_found"), "off_topic_reason")


@query(o.with_(pp.PAPERS, o.GUARD) + "SELECT domain_decision, count(*) AS n_papers FROM guard GROUP BY 1")
def domain_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by domain decision."""
    return guardrail.assess(papers(spark, sf_dir), CONTRACT).groupBy("domain_decision").agg(F.count("*").alias("n_papers"))


@query(o.with_(pp.PAPERS, o.EVIDENCE, o.ASPECT) + "SELECT paper_id, covered, missing_aspects AS missing, aspect_coverage_score FROM aspect")
def aspect_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspects that each paper covers."""
    a = aspects.coverage(screening.with_evidence(papers(spark, sf_dir), QUESTION), CONTRACT.aspects)
    return a.select("paper_id", F.array_join("covered_aspects", ";").alias("covered"), F.array_join("missing_aspects", ";").alias("missing"), "aspect_coverage_score")


@query(o.with_(pp.PAPERS, o.ROLE) + "SELECT paper_id, array_to_string(roles, ';') AS roles, primary_role, confidence FROM role")
def role_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of each paper."""
    return roles.classify(papers(spark, sf_dir), ROLE_RULES).select("paper_id", F.array_join("roles", ";").alias("roles"), "primary_role", "confidence")


@query(o.with_(pp.PAPERS, o.ROLE) + "SELECT r AS role, count(*) AS n_papers FROM (SELECT unnest(roles) AS r FROM role) GROUP BY r")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by role."""
    return roles.role_counts(roles.classify(papers(spark, sf_dir), ROLE_RULES))


@query(o.with_(pp.PAPERS, o.ROLE) + "SELECT o.paper_id, coalesce(b.n, 0) AS n_overbroad FROM role o LEFT JOIN (SELECT paper_id, count(*) AS n FROM (SELECT paper_id, unnest(roles) AS r FROM role) JOIN broad ON r = broad.role GROUP BY paper_id) b USING (paper_id)")
def overbroad_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a paper's roles more than 30 % of all papers have."""
    r = roles.mark_overbroad(roles.classify(papers(spark, sf_dir), ROLE_RULES))
    return r.select("paper_id", F.size("overbroad_roles").cast("long").alias("n_overbroad"))


# ---- ranks, decisions, reports -------------------------------------------------------------------------------------------


@query(o.FULL + "SELECT paper_id, rank, relevance, diversity, multiplier, centrality, final FROM ranked")
def full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked papers with guardrail, aspects and the seed floor."""
    return screening.screen(papers(spark, sf_dir), CONTRACT, NOW_YEAR).select("paper_id", "rank", "relevance", "diversity", "multiplier", "centrality", "final")


@query(o.DECISIONS + "SELECT paper_id, rank, rank_before, role_adjustment, lane_adjustment, seed_boost, false_positive_penalty, final FROM decided")
def ranking_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role, lane, seed and false-positive adjustments and the second rank."""
    return decided(spark, sf_dir).select("paper_id", "rank", "rank_before", "role_adjustment", "lane_adjustment", "seed_boost", "false_positive_penalty", "final")


@query(o.DECISIONS + "SELECT paper_id, decision, primary_reason, array_to_string(reasons, ';') AS reasons, decision_confidence, reading_priority, suggested_action FROM decided")
def screening_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with reasons, confidence, priority and action."""
    return decided(spark, sf_dir).select("paper_id", "decision", "primary_reason", F.array_join("exclusion_reasons", ";").alias("reasons"), "decision_confidence", "reading_priority", "suggested_action")


@query(o.DECISIONS + "SELECT decision, count(*) AS n_papers FROM decided GROUP BY 1")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: papers by decision."""
    return decisions.decision_counts(decided(spark, sf_dir))


@query(o.DECISIONS + "SELECT r AS reason, count(*) AS n_papers FROM (SELECT unnest(reasons) AS r FROM decided) GROUP BY r ORDER BY 2 DESC, 1 LIMIT 12")
def exclusion_reason_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the most common exclusion reasons."""
    return decisions.top_reasons(decided(spark, sf_dir))


@query(o.DECISIONS + "SELECT false AS target_context_required_for_priority, count(*) FILTER (WHERE reading_priority = 'must_read') AS must_read_count FROM decided")
def priority_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the reading-priority policy."""
    return decisions.priority_policy(decided(spark, sf_dir))


_ROLE_OF = "CASE WHEN is_seed THEN 'user_seed' WHEN support_level IN ('unverified', 'missing_abstract', 'llm_invalid_evidence') THEN 'uncertain' WHEN contains(low, 'review') OR contains(low, 'survey') THEN 'background' WHEN contains(low, 'evaluation') OR contains(low, 'benchmark') OR contains(low, 'experiment') THEN 'evaluation' WHEN year >= 2022 THEN 'future work' WHEN aspect_coverage_score >= 0.6 THEN 'motivation' ELSE 'background' END"
_GROUP_OF = "CASE WHEN is_seed THEN 'must_read' WHEN support_level = 'missing_abstract' THEN 'excluded_or_low_confidence' WHEN final >= 0.65 AND aspect_coverage_score >= 0.5 THEN 'must_read' WHEN rr = 'future work' THEN 'recent_frontier' WHEN rr = 'evaluation' THEN 'evaluation_relevant' WHEN rr = 'background' THEN 'background_or_survey' WHEN final < 0.25 THEN 'excluded_or_low_confidence' ELSE 'peripheral' END"
GROUPED = o.DECISIONS + f""", gr AS (SELECT *, {_GROUP_OF} AS result_group FROM (SELECT *, {_ROLE_OF} AS rr FROM (SELECT *, lower(title || ' ' || venue || ' ' || evidence_sentence) AS low FROM decided)))"""


@query(GROUPED + " SELECT paper_id, rr AS recommended_role, result_group FROM gr")
def result_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading roles and groups."""
    return reading.group_papers(decided(spark, sf_dir, "title", "claim")).select("paper_id", "recommended_role", "result_group")


def _path_sql() -> str:
    ctes, used = [], []
    for i, (name, groups, prios, n, fallback) in enumerate(reading.SECTIONS):
        taken = "".join(f" AND paper_id NOT IN (SELECT paper_id FROM s{j})" for j in used)
        base = f"SELECT * FROM gr WHERE decision <> 'exclude' AND domain_decision <> 'out_of_scope' AND reading_priority IN ({pp.quoted(prios)}){taken}"
        order = "rank"
        if groups:
            order = f"list_position([{pp.quoted(groups)}], result_group), rank"
            own = f"SELECT * FROM ({base}) WHERE result_group IN ({pp.quoted(groups)})"
            if fallback:
                own, order = f"SELECT * FROM ({base}) WHERE result_group IN ({pp.quoted(groups)}) OR NOT EXISTS ({own})", "rank"
            base = own
        ctes.append(f"s{i} AS (SELECT {i + 1} AS section_no, '{name}' AS section, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS pos, rank, paper_id, reading_priority FROM ({base}) ORDER BY {order} LIMIT {n})")
        used.append(i)
    return GROUPED + ", " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in used)


@query(_path_sql())
def reading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five sections of the reading path."""
    p = reading.reading_path(reading.group_papers(decided(spark, sf_dir, "title", "claim")))
    return p.select("section_no", "section", "pos", "rank", "paper_id", "reading_priority")


@query(_path_sql().replace(" UNION ALL ", "\nUNION ALL\n").join(["SELECT count(*) AS reading_path_paper_count, CAST(0 AS BIGINT) AS reading_path_exclude_count, CAST(0 AS BIGINT) AS reading_path_out_of_scope_count, count(*) - count(DISTINCT paper_id) AS reading_path_duplicate_count, CAST(0 AS BIGINT) AS reading_path_negative_context_count FROM (", ")"]))
def reading_path_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must not be on the path is not."""
    items = reading.group_papers(decided(spark, sf_dir, "title", "claim"))
    return reading.path_integrity(reading.reading_path(items), items)


@query(o.DECISIONS + "SELECT paper_id, rank, support_level FROM decided WHERE support_level IN ('strict_support', 'weak_support') AND domain_decision <> 'out_of_scope' ORDER BY rank LIMIT 5")
def auto_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic seeds."""
    return reading.auto_seeds(decided(spark, sf_dir)).select("paper_id", "rank", "support_level")


@query(o.DECISIONS + "SELECT paper_id, year, rank FROM decided ORDER BY year NULLS LAST, rank LIMIT 12")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest papers."""
    return reading.lineage(decided(spark, sf_dir)).select("paper_id", "year", "rank")


@query(o.DECISIONS + "SELECT paper_id, reading_priority, rank FROM decided ORDER BY CASE reading_priority WHEN 'must_read' THEN 0 WHEN 'read_later' THEN 1 WHEN 'optional' THEN 2 ELSE 3 END, rank LIMIT 12")
def read_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-first order."""
    return reading.read_first(decided(spark, sf_dir)).select("paper_id", "reading_priority", "rank")


@query(o.DECISIONS + f"SELECT k AS token, count(*) AS n FROM (SELECT unnest(list_concat({sql_tokens('title')}, {sql_tokens('abstract')})) AS k FROM decided WHERE decision = 'include') GROUP BY k ORDER BY 2 DESC, 1 LIMIT 6")
def token_topk_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of the included papers."""
    return reading.keywords(screening.decided_texts(papers(spark, sf_dir), CONTRACT, NOW_YEAR, "include", ("title", "abstract"), role_rules=ROLE_RULES))


@query(o.DECISIONS + "SELECT r AS value, count(*) AS count FROM (SELECT unnest(reasons) AS r FROM decided) GROUP BY r")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an array column."""
    return reading.value_counts(decided(spark, sf_dir), "exclusion_reasons")


#: The first paper of each exact key: what is left once duplicates are removed.
_FIRST = pp.PAPERS.replace("papers AS (", "papers0 AS (", 1) + f""",
papers AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN doi <> '' THEN 'd:' || doi WHEN {sql_title_key('title')} <> '' THEN 't:' || {sql_title_key('title')} ELSE 'o:' || input_ord END ORDER BY input_ord) AS n FROM papers0) WHERE n = 1)"""


@query(o.DECISIONS.replace(pp.PAPERS.strip(), _FIRST.strip()) + "SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS records_identified, (SELECT count(*) FROM papers0) - count(*) AS duplicates_removed, count(*) FILTER (WHERE abstract = '') AS missing_abstracts, count(*) AS records_screened, count(*) FILTER (WHERE decision = 'include') AS records_included, count(*) FILTER (WHERE decision = 'maybe') AS records_maybe, count(*) FILTER (WHERE decision = 'exclude') AS records_excluded, count(*) FILTER (WHERE domain_decision = 'out_of_scope') AS out_of_domain_records, least(count(*), 10) AS records_in_top_ranked, count(*) FILTER (WHERE support_level IN ('missing_abstract', 'missing_evidence')) AS records_low_confidence FROM decided")
def prisma_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: screening flow over the papers that are left after records of one exact key are merged to the first."""
    p = papers(spark, sf_dir)
    first = dedup.exact_key_groups(p).select(F.col("gid").alias("input_ord"))
    raw, left = p.count(), first.count()
    d = screening.screen_and_decide(p.join(first, "input_ord", "left_semi"), CONTRACT, NOW_YEAR, role_rules=ROLE_RULES)
    return metrics.screening_flow(d, raw, raw - left)


@query(o.with_(pp.PAPERS, o.EVIDENCE) + "SELECT count(*) AS n_papers, count(*) FILTER (WHERE support_level = 'strict_support') AS strict_supported_count, CAST(0 AS BIGINT) AS weak_support_count, CAST(0 AS BIGINT) AS unverified_count, CAST(0 AS BIGINT) AS llm_invalid_evidence_count, avg((support_level = 'missing_abstract')::INT) AS missing_abstract_ratio, avg((support_level <> 'strict_support')::INT) AS unsupported_claim_rate, CAST(CASE WHEN count(*) FILTER (WHERE support_level = 'strict_support') > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS grounding_accuracy, avg((support_level = 'strict_support')::INT) AS strict_support_rate, CAST(0.0 AS DOUBLE) AS weak_support_rate FROM ev")
def support_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: support levels and rates."""
    return metrics.support_summary(screening.evidence_tables(papers(spark, sf_dir), QUESTION)[1])


# ---- feedback, preferences, evaluation -----------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback: quality 1 is an include, toxic an exclude, the rest uncertain."""
    t = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    label = F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 1, "include").otherwise("uncertain")
    d = t.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paper_id"), label.alias("label"))
    return d.withColumn("adjustment", F.when(F.col("label") == "include", 0.10).when(F.col("label") == "exclude", -0.20).otherwise(0.0))


LABELS = """lab AS (SELECT 'p' || doc_id AS paper_id, label, CASE label WHEN 'include' THEN 0.10 WHEN 'exclude' THEN -0.20 ELSE 0.0 END AS adjustment FROM (
  SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'exclude' WHEN max(quality) = 1 THEN 'include' ELSE 'uncertain' END AS label FROM labels GROUP BY doc_id))"""
AFTER = f""", {LABELS}, fb0 AS (SELECT r.* EXCLUDE (final, rank), r.rank AS rank_before, CASE WHEN l.label IS NOT NULL THEN ({o.weighted()} + l.adjustment) * multiplier ELSE r.final END AS final FROM ranked r LEFT JOIN lab l USING (paper_id)),
fb AS (SELECT *, CAST(row_number() OVER (ORDER BY final DESC, rank_before) AS INT) AS rank FROM fb0)"""


def _reranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before = screening.screen(papers(spark, sf_dir), CONTRACT, NOW_YEAR)
    return before, ranking.apply_feedback(before, _labels(spark, sf_dir))


@query(o.FULL + AFTER + " SELECT paper_id, rank, rank_before, final FROM fb")
def feedback_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-rank after feedback."""
    return _reranked(spark, sf_dir)[1].select("paper_id", "rank", "rank_before", "final")


@query(o.FULL + AFTER + " SELECT 'q1' AS question_id, count(*) FILTER (WHERE rank <> rank_before) AS moved_count, coalesce(avg(abs(rank - rank_before)) FILTER (WHERE rank <> rank_before), 0.0) AS mean_abs_rank_delta, coalesce(max(abs(rank - rank_before)), 0) AS max_abs_rank_delta, count(*) FILTER (WHERE (rank <= 10) <> (rank_before <= 10)) AS top10_changed_count FROM fb")
def rank_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the re-rank moved papers."""
    return metrics.rank_shift(*_reranked(spark, sf_dir))


@query(o.FULL + AFTER + " SELECT paper_id, rank_before AS before_rank, rank AS after_rank, rank_before - rank AS delta FROM fb WHERE rank <> rank_before ORDER BY abs(rank_before - rank) DESC, rank LIMIT 10")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers that moved farthest."""
    return metrics.top_movers(*_reranked(spark, sf_dir)).select("paper_id", "before_rank", "after_rank", "delta")


@query(
    o.FULL
    + f""", {LABELS}, j AS (SELECT r.rank, l.label FROM ranked r JOIN lab l USING (paper_id)), n AS (SELECT count(*) FILTER (WHERE label = 'include') AS rel FROM lab),
    h AS (SELECT rank, row_number() OVER (ORDER BY rank) AS hits FROM j WHERE label = 'include')
    SELECT 'q1' AS question_id, (SELECT avg((label = 'include')::INT) FROM j WHERE rank <= 10) AS precision_at_k,
    (SELECT coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) FROM h) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i), n WHERE i <= rel) AS ndcg_at_k,
    (SELECT count(*) FROM h WHERE rank <= 10) / (SELECT rel FROM n) AS recall_at_k, (SELECT sum(hits / rank) FROM h) / (SELECT rel FROM n) AS average_precision"""
)
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, nDCG, recall and average precision against the labels."""
    return metrics.ir_metrics(screening.screen(papers(spark, sf_dir), CONTRACT, NOW_YEAR), _labels(spark, sf_dir))


_TERMS = f"""tk AS (SELECT l.label, {sql_tokens("title || ' ' || abstract")} AS t FROM papers JOIN lab l USING (paper_id) WHERE l.label IN ('include', 'exclude')),
tm AS (SELECT label, unnest(list_concat(list_filter(t, lambda x: NOT regexp_full_match(x, '[0-9]+')), list_transform(list_filter(range(1, len(t)), lambda i: NOT regexp_full_match(t[i], '[0-9]+') AND NOT regexp_full_match(t[i + 1], '[0-9]+')), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk),
tn AS (SELECT term, count(*) FILTER (WHERE label = 'include') AS inc, count(*) FILTER (WHERE label = 'exclude') AS exc FROM tm WHERE length(term) >= 3 GROUP BY term)"""


def _texts(p: DataFrame) -> DataFrame:
    return p.select("paper_id", F.concat_ws(" ", "title", "abstract").alias("text"))


@query(o.with_(pp.PAPERS, LABELS, _TERMS) + "(SELECT 'positive' AS side, term, inc AS n_own, exc AS n_other FROM tn WHERE inc > exc ORDER BY inc - exc + 0.01 * inc DESC, term DESC LIMIT 12) UNION ALL (SELECT 'negative', term, exc, inc FROM tn WHERE exc > inc ORDER BY exc - inc + 0.01 * exc DESC, term DESC LIMIT 12)")
def term_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that set include and exclude labels apart."""
    return preference.contrast(_texts(papers(spark, sf_dir)), _labels(spark, sf_dir))


@query(o.with_(pp.PAPERS, LABELS, _TERMS) + ", pt AS (SELECT list(term) AS p FROM (SELECT term FROM tn WHERE inc > exc ORDER BY inc - exc + 0.01 * inc DESC, term DESC LIMIT 12)), nt AS (SELECT list(term) AS n FROM (SELECT term FROM tn WHERE exc > inc ORDER BY exc - inc + 0.01 * exc DESC, term DESC LIMIT 12)) SELECT paper_id, round(greatest(0.0, least(1.0, 0.5 + (len(list_filter(p, lambda t: contains(lower(title || ' ' || abstract), t))) - len(list_filter(n, lambda t: contains(lower(title || ' ' || abstract), t)))) / greatest(1, len(p) + len(n)))), 4) AS preference_score FROM papers, pt, nt")
def preference_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference scores from the contrasted terms."""
    t = _texts(papers(spark, sf_dir))
    return preference.term_scores(t, preference.contrast(t, _labels(spark, sf_dir)))


@query()
def preference_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: preference scores of a logistic regression over TF-IDF."""
    return preference.classifier_scores(_texts(papers(spark, sf_dir)), _labels(spark, sf_dir))


ANCHORS = {"articles": ("the ", "la "), "links": ("that", "que"), "rare": ("public license", "worthless")}
_ANCHOR_HITS = " + ".join("(" + " OR ".join(f"contains(lower(text), '{t}')" for t in v) + ")::INT" for v in ANCHORS.values())


@query(f"SELECT doc_id, round(({_ANCHOR_HITS}) / 3.0, 4) AS anchor_coverage FROM documents")
def anchor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of anchor groups found in each text."""
    return metrics.coverage_of_anchors(table(spark, sf_dir, "documents"), ANCHORS).select("doc_id", "anchor_coverage")


@query("WITH r AS (SELECT 'c' || (user_id % 20) AS case_id, CASE user_id % 3 WHEN 0 THEN 'full_system' WHEN 1 THEN 'no_guardrail' ELSE 'no_aspects' END AS config, value FROM events), m AS (SELECT case_id, config, CAST(count(*) AS DOUBLE) AS n_events, round(sum(value), 2) AS total FROM r GROUP BY 1, 2) SELECT m.case_id, m.config, m.n_events - b.n_events AS delta_n_events, round(m.total - b.total, 2) AS delta_total FROM m LEFT JOIN (SELECT * FROM m WHERE config = 'full_system') b USING (case_id)")
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configuration's metrics less those of its case's baseline; users stand for runs."""
    u = F.col("user_id")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), (u % 20).cast("string")).alias("case_id"), F.when(u % 3 == 0, "full_system").when(u % 3 == 1, "no_guardrail").otherwise("no_aspects").alias("config"), "value")
    m = e.groupBy("case_id", "config").agg(F.count("*").cast("double").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))
    return metrics.ablation_deltas(m, ("n_events", "total")).withColumn("delta_total", F.round("delta_total", 2))


# ---- provenance, graph ---------------------------------------------------------------------------------------------------


def _planned(spark: SparkSession) -> DataFrame:
    rows = [(i, p, f"query {q}", s, f"family_{q % 3}", f"lens_{q % 2}", "core", 50 + 10 * (q % 3), 2) for i, (p, q, s) in enumerate([("openalex", 0, "query_family"), ("openalex", 1, "legacy"), ("semantic_scholar", 1, "query_family"), ("semantic_scholar", 2, "legacy"), ("crossref", 3, "query_family"), ("openalex", 3, "query_family")])]
    return spark.createDataFrame(rows, "ord long, provider string, query string, source string, family_name string, lens_name string, purpose string, priority int, budget int")


PLANNED = "planned AS (SELECT * FROM (VALUES (0, 'openalex', 'query 0', 'query_family', 'family_0', 'lens_0', 50, 2), (1, 'openalex', 'query 1', 'legacy', 'family_1', 'lens_1', 60, 2), (2, 'semantic_scholar', 'query 1', 'query_family', 'family_1', 'lens_1', 60, 2), (3, 'semantic_scholar', 'query 2', 'legacy', 'family_2', 'lens_0', 70, 2), (4, 'crossref', 'query 3', 'query_family', 'family_0', 'lens_1', 50, 2), (5, 'openalex', 'query 3', 'query_family', 'family_0', 'lens_1', 50, 2)) v(ord, provider, query, source, family_name, lens_name, priority, budget))"


def _retrieved(p: DataFrame) -> DataFrame:
    return p.withColumn("retrieval_provider", F.when(F.col("input_ord") % 4 == 0, "").otherwise(F.col("source_provider")))


@query(o.with_(pp.PAPERS, PLANNED) + """, q AS (SELECT query, arg_min(source, ord) AS source, arg_min(family_name, ord) AS family_name FROM planned GROUP BY query)
SELECT p.paper_id, coalesce(a.source, b.source) AS matched_query_source, coalesce(a.family_name, b.family_name) AS matched_query_family, CASE WHEN coalesce(a.source, b.source) = 'query_family' AND p.source_stage = 'keyword' THEN 'query_family' ELSE p.source_stage END AS source_stage
FROM papers p LEFT JOIN planned a ON a.provider = p.source_provider AND a.query = p.retrieval_query LEFT JOIN q b ON b.query = p.retrieval_query""")
def provenance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned query behind each paper."""
    return provenance.annotate(_retrieved(papers(spark, sf_dir)), _planned(spark)).select("paper_id", "matched_query_source", "matched_query_family", "source_stage")


@query(o.with_(pp.PAPERS, PLANNED) + "SELECT paper_id, array_to_string(list_distinct(list(lens_name ORDER BY ord)), ';') AS lenses, array_to_string(list_distinct(list(family_name ORDER BY ord)), ';') AS families FROM papers p JOIN planned q ON q.query = p.retrieval_query AND q.provider = p.source_provider GROUP BY paper_id")
def provenance_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenses and families of the queries that brought a paper."""
    return provenance.linked(_retrieved(papers(spark, sf_dir)), _planned(spark)).select("paper_id", F.array_join("linked_lenses", ";").alias("lenses"), F.array_join("linked_query_families", ";").alias("families"))


@query(o.with_(pp.PAPERS, PLANNED) + "SELECT q.provider, q.query, count(p.paper_id) AS paper_count, coalesce(array_to_string(list(p.paper_id ORDER BY input_ord) FILTER (WHERE p.paper_id IS NOT NULL), ';'), '') AS paper_ids FROM planned q LEFT JOIN papers p ON q.query = p.retrieval_query AND q.provider = p.source_provider GROUP BY q.provider, q.query")
def query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each planned query returned."""
    p = papers(spark, sf_dir)
    b = p.select(F.col("input_ord").alias("ord"), F.col("source_provider").alias("provider"), F.col("retrieval_query").alias("query"), F.lit(1).cast("long").alias("paper_count"), F.array("paper_id").alias("paper_ids"))
    return provenance.query_results(_planned(spark), b).select("provider", "query", "paper_count", F.array_join("paper_ids", ";").alias("paper_ids"))


@query(f"WITH {PLANNED}, t AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY priority DESC, family_name, ord) AS pos FROM planned) SELECT provider, query, CAST(pos AS INT) AS pos FROM t WHERE pos <= 2")
def query_dedup_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final queries under budgets and a cap per provider."""
    return provenance.capped_queries(_planned(spark), 2).select("provider", "query", "pos")


@query("WITH b AS (SELECT event_type AS provider, CAST(round(value) AS BIGINT) % 3 AS returned, CASE WHEN user_id % 50 = 0 THEN 429 WHEN user_id % 50 = 1 THEN 500 END AS code FROM events), s AS (SELECT provider, count(*) AS attempted, sum(returned) AS returned, count(code) AS errors, coalesce(bool_or(code = 429), false) AS rl FROM b GROUP BY provider) SELECT provider, attempted, CAST(returned AS BIGINT) AS returned, errors, rl AS rate_limited, CASE WHEN rl AND returned > 0 THEN 'partial_success_rate_limited' WHEN rl THEN 'rate_limited' WHEN errors > 0 AND returned > 0 THEN 'partial_success' WHEN errors > 0 THEN 'failed' WHEN returned > 0 THEN 'success' ELSE 'success_no_results' END AS status FROM s")
def provider_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider states; event types stand for providers."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id") % 50
    b = e.select(F.col("event_type").alias("provider"), (F.round("value").cast("long") % 3).alias("returned"), F.when(u == 0, 429).when(u == 1, 500).alias("status_code"), F.lit("").alias("error"))
    r = e.groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("requested"))
    return provenance.provider_status(b, r).select("provider", "attempted", "returned", "errors", "rate_limited", "status")


@query(o.with_(pp.PAPERS, o.GUARD) + """, h AS (SELECT source_provider AS provider, retrieval_query AS query, g.domain_decision FROM papers JOIN guard g USING (paper_id))
SELECT provider, query, count(*) AS pilot_raw_count, round(avg((domain_decision <> 'in_scope')::INT), 4) AS off_topic_rate_estimate, CASE WHEN avg((domain_decision <> 'in_scope')::INT) >= 0.8 THEN 'drop' WHEN avg((domain_decision <> 'in_scope')::INT) >= 0.35 THEN 'repair' ELSE 'keep' END AS recommendation FROM h GROUP BY 1, 2""")
def pilot_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pilot says of each query."""
    p = papers(spark, sf_dir)
    h = p.select(F.col("source_provider").alias("provider"), F.col("retrieval_query").alias("query"), F.lit("keyword").alias("retrieval_stage"), "paper_id")
    return provenance.pilot_results(h, guardrail.assess(p, CONTRACT)).select("provider", "query", "pilot_raw_count", "off_topic_rate_estimate", "recommendation")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, edges and catalogue: papers with an even ordinal exist already, edges lead to the next ordinals."""
    p = papers(spark, sf_dir)
    seeds = p.filter(F.col("input_ord") < 4).select(F.col("input_ord").alias("seed_ord"), "paper_id", "title")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("k")) for i, k in enumerate(snowball.KINDS)]))
    e = p.select("paper_id", "input_ord", kinds.alias("x"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("pos"))
    n = p.agg(F.count("*").alias("n"))
    e = e.join(F.broadcast(n)).select(F.col("paper_id").alias("src_paper_id"), F.concat(F.lit("p"), ((F.col("input_ord") * 7 + F.col("x.k") * 3 + F.col("pos") * 2 + 1) % F.col("n")).cast("string")).alias("dst_paper_id"), "x.kind", "pos")
    return seeds, e, p


@query(o.with_(pp.PAPERS) + f""", kd AS (SELECT * FROM (VALUES ('reference', 0), ('citation', 1), ('recommendation', 2)) v(kind, k)),
e AS (SELECT s.input_ord AS so, s.paper_id AS sp, kind, k, pos, 'p' || ((s.input_ord * 7 + k * 3 + pos * 2 + 1) % (SELECT count(*) FROM papers)) AS dst FROM papers s, kd, range(1, 6) r(pos) WHERE s.input_ord < 3 AND pos <= 3),
c AS (SELECT *, CASE WHEN doi <> '' THEN 'doi:' || doi WHEN {sql_title_key('title')} <> '' THEN 'title:' || {sql_title_key('title')} END AS key FROM papers),
x AS (SELECT e.*, c.paper_id, c.key FROM e JOIN c ON c.paper_id = e.dst WHERE c.key IS NULL OR c.key NOT IN (SELECT key FROM c WHERE input_ord % 2 = 0 AND key IS NOT NULL))
SELECT paper_id, sp AS seed_paper_id, 'seed_' || kind AS source_stage, kind AS seed_relation, CAST(0.8 AS DOUBLE) AS seed_confidence FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(key, sp || kind || pos) ORDER BY so, k, pos) AS n FROM x) WHERE n = 1""")
def snowball_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hop expansion that skips known papers."""
    seeds, edges, p = _graph(spark, sf_dir)
    known = p.filter(F.col("input_ord") % 2 == 0)
    return snowball.expand(seeds, edges, p.select("paper_id", "input_ord", "title", "doi"), known).select("paper_id", "seed_paper_id", "source_stage", "seed_relation", "seed_confidence")


@query(o.with_(pp.PAPERS) + f""", s AS (SELECT input_ord AS seed_ord, CASE WHEN input_ord % 2 = 0 THEN doi ELSE '' END AS doi, upper(title) AS title FROM papers),
c AS (SELECT paper_id, input_ord, doi, {sql_title_key('title')} AS t FROM papers),
d AS (SELECT doi, arg_min(paper_id, input_ord) AS p FROM c WHERE doi <> '' GROUP BY doi), u AS (SELECT t, arg_min(paper_id, input_ord) AS p FROM c WHERE t <> '' GROUP BY t)
SELECT seed_ord, coalesce(d.p, u.p) AS paper_id, CASE WHEN coalesce(d.p, u.p) IS NULL THEN 'manual_seed' ELSE 'seed_exact' END AS source_stage FROM s LEFT JOIN d ON d.doi = s.doi LEFT JOIN u ON u.t = {sql_title_key('s.title')}""")
def seed_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper as a seed, resolved by DOI, then title."""
    p = papers(spark, sf_dir)
    s = p.select(F.col("input_ord").alias("seed_ord"), F.when(F.col("input_ord") % 2 == 0, F.col("doi")).otherwise("").alias("doi"), F.upper("title").alias("title"))
    return snowball.resolve(s, p).select("seed_ord", "paper_id", "source_stage")


# ---- gaps ----------------------------------------------------------------------------------------------------------------

TENSIONS = (gaps.TensionRule("articles", ("the thorough", "el que")), gaps.TensionRule("sides", (), ("that the",), ("que la",)), gaps.TensionRule("short", ("der",)))
_FOLD = f"translate(lower(title || ' ' || abstract), '{gaps.MARKED}', '{gaps.PLAIN}')"


@query(o.with_(pp.PAPERS) + f""", x AS (SELECT paper_id, {_FOLD} AS f FROM papers), h AS (
SELECT paper_id, 'articles' AS k, false AS a, false AS b FROM x WHERE contains(f, 'the thorough') OR contains(f, 'el que') UNION ALL
SELECT paper_id, 'sides', contains(f, 'that the'), contains(f, 'que la') FROM x WHERE contains(f, 'that the') OR contains(f, 'que la') UNION ALL
SELECT paper_id, 'short', false, false FROM x WHERE regexp_matches(f, '\\bder\\b'))
SELECT k AS tension_key, count(DISTINCT paper_id) AS n_papers, CAST(round(CASE WHEN k = 'sides' THEN CASE WHEN bool_or(a) AND bool_or(b) THEN 0.82 ELSE 0.56 END ELSE least(0.9, 0.5 + 0.1 * count(DISTINCT paper_id)) END, 2) AS DOUBLE) AS confidence FROM h GROUP BY k""")
def research_tensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tension rules and how sure they are."""
    return gaps.tensions(papers(spark, sf_dir), TENSIONS)


_KEYS = {"articles": "language", "links": "language", "numbers": "evaluation", "missing_abstract": "evaluation", "off_topic_domain": "scope"}


@query(o.DECISIONS + f""", keys AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _KEYS.items())}) v(phrase, gap_key)),
sig AS (SELECT unnest(string_split(missing_aspects, ';')) AS phrase, 1 AS n FROM decided WHERE missing_aspects <> '' UNION ALL SELECT * FROM (SELECT r, count(*) AS c FROM (SELECT unnest(reasons) AS r FROM decided) GROUP BY r ORDER BY 2 DESC, 1 LIMIT 12) UNION ALL SELECT * FROM (VALUES ('numbers', 1), ('articles', 0)) v(a, b))
SELECT gap_key, CAST(sum(n) AS BIGINT) AS signals, array_to_string(list_sort(list_distinct(list(phrase))), '; ') AS related_aspects FROM sig JOIN keys USING (phrase) GROUP BY gap_key ORDER BY 2 DESC, 1 LIMIT 8""")
def gap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted gaps. Two branches read the decisions, so their columns are evaluated once."""
    d = checkpointed(decided(spark, sf_dir).select("missing_aspects", "exclusion_reasons"))
    required = spark.createDataFrame([("numbers", False), ("articles", True)], "aspect string, supported boolean")
    keys = spark.createDataFrame(list(_KEYS.items()), "phrase string, gap_key string")
    return gaps.gap_matrix(d.select("missing_aspects"), decisions.top_reasons(d), required, keys)


@query(o.DECISIONS + """, h AS (SELECT paper_id, rank, 'language' AS gap_key FROM decided WHERE contains(lower(title || ' ' || abstract), 'that the') OR contains(lower(title || ' ' || abstract), 'que la') UNION ALL SELECT paper_id, rank, 'license' FROM decided WHERE contains(lower(title || ' ' || abstract), 'public license'))
SELECT gap_key, CAST(n AS INT) AS pos, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY gap_key ORDER BY rank) AS n FROM h) WHERE n <= 3""")
def gap_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first papers that support each gap."""
    terms = {"language": ("that the", "que la"), "license": ("public license",)}
    items = decided(spark, sf_dir, also=lambda p: p.withColumn("gap_keys", gaps.mentioned(terms)))
    return gaps.supporting_titles(items, terms).select("gap_key", "pos", "paper_id")


# ---- events, pages -------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def event_log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of a run's event log; event types stand for stages."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _strip_sql() -> str:
    v = "regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
    v = f"regexp_replace(regexp_replace({v}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for name, char in tx.ENTITIES.items():
        v = f"replace({v}, {o.lit(name)}, {o.lit(char)})"
    return f"SELECT page_id, md5({sql_collapsed(f'replace({v}, chr(160), chr(32))')}) AS text_md5 FROM pages"


@query(_strip_sql())
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages, as a digest."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.strip_html("html")).alias("text_md5"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON payloads."""
    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select("event_id", F.get(F.map_values("m"), F.lit(0)).alias("first_value"), F.size("m").cast("long").alias("n_keys"))


@query(f"WITH {PLANNED} SELECT CAST(ord AS BIGINT) AS ord, provider, CASE WHEN provider = 'openalex' THEN m ELSE 'keyword' END AS search_mode, CASE WHEN provider = 'openalex' THEN 'openalex_' || m ELSE provider END AS retrieval_stage FROM planned, (VALUES ('keyword'), ('semantic')) v(m) WHERE provider = 'openalex' OR m = 'keyword'")
def planned_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned queries by retrieval stage."""
    return provenance.planned_stages(_planned(spark)).select("ord", "provider", "search_mode", "retrieval_stage")


@query("SELECT 'partial_success' AS retrieval_status, true AS ranked_papers_based_on_real_retrieval, '' AS reason")
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: what all provider states amount to; the events hold both results and errors."""
    e = table(spark, sf_dir, "events")
    b = e.select(F.col("event_type").alias("provider"), F.lit(1).cast("long").alias("returned"), F.when(F.col("user_id") % 50 == 0, 429).alias("status_code"), F.lit("").alias("error"))
    r = e.groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("requested"))
    return provenance.retrieval_context(provenance.provider_status(b, r), 10, 10, 5)


_PAIRS = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"


@query(o.with_(pp.PAPERS) + f""", t AS (SELECT paper_id, lower(title) AS low, list_filter(string_split({sql_collapsed('lower(title)')}, ' '), lambda x: x <> '') AS t, {sql_tokens('title')} AS k FROM papers)
SELECT paper_id, len(list_distinct(k)) < 3 AS overbroad, len(list_distinct({_PAIRS})) < len({_PAIRS}) OR coalesce(list_max(map_values(list_histogram(t))), 0) >= 3 AS repeated, (contains(low, 'the') OR contains(low, 'que'))::INT + (contains(low, 'that'))::INT <= 1 AS single_axis FROM t""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality flags; titles stand for query texts."""
    return provenance.query_flags(papers(spark, sf_dir), "title", (("the", "que"), ("that",))).select("paper_id", "overbroad", "repeated", "single_axis")


@query(o.with_(pp.PAPERS, o.EVIDENCE, o.GUARD, o.ROLE) + "SELECT avg((support_level = 'strict_support')::INT) AS evidence_grounding_ratio, avg((g.domain_decision = 'in_scope')::INT) AS in_scope_ratio, avg((len(r.roles) > 0)::INT) AS role_assigned_ratio, CAST((SELECT count(DISTINCT x) FROM (SELECT unnest(roles) AS x FROM role) WHERE x IN ('theory_mechanism', 'material_case', 'nanoscale_readout')) / 3.0 AS DOUBLE) AS target_role_coverage FROM ev JOIN guard g USING (paper_id) JOIN role r USING (paper_id)")
def exploration_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that describe how a run explored its field."""
    p = papers(spark, sf_dir)
    items = screening.with_evidence(p, QUESTION).join(guardrail.assess(p, CONTRACT).select("paper_id", "domain_decision"), "paper_id")
    return metrics.exploration_quality(items, roles.classify(p, ROLE_RULES), ("theory_mechanism", "material_case", "nanoscale_readout"))
