"""Queries of term search, glossaries and the query gate, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.functions import matcher
from quillscreen.functions import text as tx
from quillscreen.operators import anchors, glossary, run_metrics, term_groups
from quillscreen.operators.store import checkpoint_dir
from quillscreen.plans import incremental
from quillscreen.plans import oracle as o
from quillscreen.plans import queries as q
from quillscreen.plans.contract import Group
from quillscreen.plans.papers import CONTRACT, NOW_YEAR, ROLE_RULES, papers, quoted, sql_collapsed, sql_sentences, sql_tokens

query, table, lit = q.query, q.table, o.lit

# ---- terms -----------------------------------------------------------------------------------------------------------

#: The terms are the first one to four words of each benchmark item, so their number follows that table, which a driver can hold.
TERMS_SQL = """terms AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS n FROM (
  SELECT DISTINCT lower(array_to_string(w[1:k], ' ')) AS term FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), range(1, 5) AS r(k) WHERE len(w) >= k))"""


def benchmark_terms(spark: SparkSession, sf_dir: str) -> list[str]:
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    each = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.when(F.size(w) >= k, F.lower(F.array_join(F.slice(w, 1, k), " "))))).alias("term"))
    return [r.term for r in each.filter("term IS NOT NULL").distinct().orderBy("term").collect()]


@query(f"""WITH {TERMS_SQL}, found AS (SELECT doc_id, n, strpos(lower(text), term) - 1 AS first FROM documents, terms WHERE contains(lower(text), term))
SELECT doc_id, count(*) AS n_terms, md5(string_agg(n || ':' || first, ',' ORDER BY n)) AS terms_md5 FROM found GROUP BY doc_id""")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms that a document holds, with the place of the first occurrence, from one pass over the text."""
    terms = benchmark_terms(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", matcher.first_hits(F.lower("text"), terms).alias("h"))
    return d.filter(F.size("h") > 0).select("doc_id", F.size("h").cast("long").alias("n_terms"), F.md5(F.array_join(F.transform("h", lambda h: F.concat_ws(":", h["term"], h["start"])), ",")).alias("terms_md5"))


@query(f"""WITH {TERMS_SQL}, pattern AS (SELECT string_agg(term, '|' ORDER BY length(term) DESC, term) AS p FROM terms),
found AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), (SELECT p FROM pattern)) AS f FROM documents)
SELECT doc_id, CAST(len(f) AS BIGINT) AS n_hits, md5(array_to_string(f, '|')) AS hits_md5 FROM found""")
def longest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the leftmost-longest occurrences that do not overlap, in order."""
    terms = benchmark_terms(spark, sf_dir)
    low = F.lower(tx.text("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", low.alias("t"), matcher.longest(low, terms).alias("h"))
    words = F.array(*[F.lit(t) for t in terms])
    return d.select("doc_id", F.size("h").cast("long").alias("n_hits"), F.md5(F.array_join(F.transform("h", lambda h: F.get(words, h["term"])), "|")).alias("hits_md5"))


#: A glossary over the languages of the test texts, with entries inside others.
GLOSSARY = {"de la": "of the", "la": "the", "und die": "and the; as well as the", "die": "the (plural)", "nicht": "not", "ich": "I | self", "thand the": "near the", "and the": "And The", "worthless": "without value"}
PHRASES = {"license": "license; permission", "the": "The; article"}


def _glossary_sql() -> str:
    count = lambda w: f"(length(t) - length(replace(t, {lit(w)}, ''))) // {len(w)}"
    parts = []
    for w in sorted(GLOSSARY, key=lambda w: (-len(w), list(GLOSSARY).index(w))):
        # A longer entry takes the place of its first occurrence only, if that is free itself; here no entry lies two deep.
        over = " - ".join(["0", *(f"CASE WHEN contains(t, {lit(v)}) THEN {v.count(w)} ELSE 0 END" for v in GLOSSARY if v != w and w in v and not any(v != u and v in u for u in GLOSSARY))])
        parts.append((f"{count(w)} + ({over}) > 0" if over != "0" else f"contains(t, {lit(w)})", GLOSSARY[w]))
    parts += [(f"contains(t, {lit(p)})", PHRASES[p]) for p in PHRASES]
    lists = ", ".join(f"CASE WHEN {when} THEN [{quoted(glossary.targets(to))}] ELSE [] END" for when, to in parts)
    return f"""WITH f AS (SELECT doc_id, flatten([{lists}]) AS a FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))
SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), '; ') AS terms FROM f"""


@query(_glossary_sql())
def glossary_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: glossary terms of each document, longer entries first, none inside another, without repeats."""
    d = glossary.glossary_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), F.lower("text"), GLOSSARY, PHRASES)
    return d.select("doc_id", F.array_join("terms", "; ").alias("terms"))


# ---- query gate --------------------------------------------------------------------------------------------------------

FRAME = anchors.Frame(
    research_object=("the thanedble", "eriner", "la elle", "und der gesicht"), core_terms=("of the and", "review", "que"), domain_context=("that there onto", "de"), material_or_case_terms=("nicht", "worthless"),
    method_terms=("by for",), mechanism_terms=("les mechanism",), relation_or_effect=("that",), downweighted_terms=("importance",),
)
GROUPS = (Group("setting_context", ("the", "la", "der", "le")), Group("core_topic", ("zzz",)), Group("side_process", ("zzz",), required=False))
FILMS = anchors.Frame(research_object=("thin film deposition", "MOF adsorption"), core_terms=("films",), method_terms=("LLM", "sputtering"))
#: What stands before the title in a query of the second gate, by the number of the document.
LEADS = (
    "", "representative materials", "MOF", "MOF carbon dioxide pore review thin film", "MOF review of water", "ald thin film", "sputtering pld", "sputtering and pld with cvd methods for thin film co2", "SEI", "deposition techniques for films in co2 capture",
    "films comparison", "films comparison sputtering", "films comparison sputtering substrates growth", "thin film sputtering pld cvd co2", "review", "mof co2", "mof co2 adsorption at",
)
TITLES = f"""SELECT 'd' || doc_id AS query_id, coalesce({sql_sentences(sql_collapsed('text'))}[1], '') AS query, CASE WHEN doc_id % 23 = 0 THEN 'seed_context' ELSE 'planner' END AS source FROM documents
UNION ALL SELECT 'p' || page_id, regexp_extract(html, '<title>([^<]*)</title>', 1), 'pages' FROM pages
UNION ALL SELECT 'l' || doc_id, CASE WHEN len({sql_tokens('text')}) > 2 THEN array_to_string({sql_tokens('text')}[1:3], '" + (') ELSE '' END, NULL FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'w' || doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(regexp_extract(text, '[A-Za-z]+', 0)) ELSE lower(regexp_extract(text, '[A-Za-z]+', 0)) || ' OR ' END, '' FROM documents WHERE text IS NOT NULL"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of documents and pages, and the first three tokens and the first word of documents, as queries."""
    d, p = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "pages")
    some, w = d.filter("text IS NOT NULL"), tx.tokens("text")
    one = F.regexp_extract("text", "[A-Za-z]+", 0)
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("query_id")
    parts = [
        d.select(named("d", "doc_id"), tx.first_sentence("text").alias("query"), F.when(F.col("doc_id") % 23 == 0, "seed_context").otherwise("planner").alias("source")),
        p.select(named("p", "page_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("query"), F.lit("pages").alias("source")),
        some.select(named("l", "doc_id"), F.when(F.size(w) > 2, F.array_join(F.slice(w, 1, 3), '" + (')).otherwise("").alias("query"), F.lit(None).cast("string").alias("source")),
        some.select(named("w", "doc_id"), F.when(F.col("doc_id") % 2 == 0, F.upper(one)).otherwise(F.concat(F.lower(one), F.lit(" OR "))).alias("query"), F.lit("").alias("source")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _plain_sql(e: str) -> str:
    return sql_collapsed(f"translate(lower({e}), '\"+()', '    ')")


def _full(term: str) -> str:
    t, words = anchors.plain(term), sorted(set(tx.py_tokens(anchors.plain(term))))
    return f"(contains(low, {lit(t)})" + (f" OR list_has_all(toks, [{quoted(words)}]))" if words else ")")


def _loose(term: str) -> str:
    words = sorted(set(tx.py_tokens(anchors.plain(term))))
    return f"({_full(term)} OR len(list_intersect(list_distinct(toks), [{quoted(words)}])) >= 2)" if len(words) > 2 else _full(term)


def _or(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")" if parts else "false"


#: The first test of one-word queries, in SQL.
LONE = """(len(ws) = 1 AND (length(ws[1]) <= 1 OR (upper(ws[1]) = ws[1] AND regexp_full_match(ws[1], '[A-Z0-9][A-Z0-9-]{1,8}')) OR (length(ws[1]) <= 12 AND lower(ws[1]) NOT IN ('review', 'mechanism', 'method'))))"""
WORDS_SQL = "list_filter(regexp_split_to_array(regexp_replace(translate(query, '+\"()', '    '), '\\b(AND|OR|NOT)\\b', ' ', 'gi'), '\\s+'), lambda w: w <> '') AS ws"


def gate_sql(source: str, frame: anchors.Frame, groups: tuple[Group, ...], critic: str, films: str) -> str:
    a = frame.anchors()
    once = lambda ts: list({anchors.plain(t): t for t in ts}.values())
    core, second, need = a[anchors.CORE], a[anchors.SECONDARY], a[anchors.NEED]
    missing = ", ".join(f"CASE WHEN NOT {_or([_loose(t) for t in ts])} THEN {lit(n)} END" for n, ts in anchors.required_anchor_groups(groups))
    missing = f"list_filter([{missing}], lambda v: v IS NOT NULL)" if missing else "[]"
    rules = [
        ("trim(query) = ''", "empty_query"), ("coalesce(source, '') = 'seed_context'", "seed_context"), (LONE, "single_acronym_only_query"), (f"({critic}) <> ''", "accepted_rule_query_critic_issue"), ("len(missing) > 0", "missing_required_context_or_process_anchor"),
        ("has_need AND NOT has_core", "method_or_need_only_query"), ("NOT has_core" if core else "false", "missing_core_object_anchor"), ("NOT has_second" if second else "false", "missing_context_or_process_anchor"), (films, "thin_film_method_comparison_anchor_passed"),
        ("false" if second else "n_core < 2 AND NOT has_need", "missing_second_anchor"), ("false" if second else f"(len(toks) <= 2 OR (len(toks) <= 4 AND len(list_intersect(toks, [{quoted(anchors.BROAD_WORDS)}])) > 0))", "broad_standalone_query"),
    ]
    return f"""WITH qs AS ({source}), p AS (SELECT *, {_plain_sql('query')} AS low, {WORDS_SQL} FROM qs), t AS (SELECT *, {sql_tokens('low')} AS toks FROM p),
h AS (SELECT *, {_or([_loose(t) for t in core])} AS has_core, {_or([_loose(t) for t in second])} AS has_second, {_or([_loose(t) for t in need])} AS has_need, {' + '.join(f'CAST({_full(t)} AS INT)' for t in once(core)) or '0'} AS n_core, {missing} AS missing FROM t),
r AS (SELECT *, CASE {' '.join(f'WHEN {when} THEN {lit(name)}' for when, name in rules)} ELSE 'anchor_rule_passed' END AS reason FROM h)
SELECT query_id, reason, reason IN ('seed_context', 'thin_film_method_comparison_anchor_passed', 'anchor_rule_passed') AS keep, CASE WHEN reason = 'accepted_rule_query_critic_issue' THEN {critic} ELSE '' END AS critic_issue,
       CASE WHEN reason = 'missing_required_context_or_process_anchor' THEN array_to_string(missing, ';') ELSE '' END AS missing_groups FROM r"""


def _gated(d: DataFrame) -> DataFrame:
    return d.select("query_id", "reason", "keep", "critic_issue", F.array_join("missing_groups", ";").alias("missing_groups"))


@query(gate_sql(TITLES, FRAME, GROUPS, "''", "false"))
def query_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles and first words as queries, kept or dropped by their anchors."""
    return _gated(anchors.gate(titles(spark, sf_dir), FRAME, GROUPS))


_HOLDS = lambda words: _or([f"contains(low, {lit(w)})" for w in words])
_COUNT = lambda words: "(" + " + ".join(f"CAST(contains(low, {lit(w)}) AS INT)" for w in words) + ")"
_MOF, _CMP = "(list_contains(toks, 'mof') OR contains(low, 'metal organic framework'))", _HOLDS(anchors.COMPARISON)
CRITIC_SQL = f"""CASE WHEN {_HOLDS(anchors.AI_POLLUTION)} THEN 'cross_domain_pollution:ai_screening_material_template_terms' WHEN contains(low, 'representative materials') THEN 'cross_domain_pollution:mof_representative_materials_template'
WHEN {_MOF} AND len(toks) <= 3 THEN 'overbroad_queries:mof_short_anchor_only' WHEN {_MOF} AND NOT {_HOLDS(anchors.CAPTURE_CONTEXT)} THEN 'overbroad_queries:mof_missing_co2_adsorption_context'
WHEN {_MOF} AND NOT {_HOLDS(anchors.CAPTURE_ASPECTS)} AND len(toks) <= 4 THEN 'overbroad_queries:mof_missing_aspect_or_review_intent'
WHEN (contains(low, 'atomic layer deposition') OR list_contains(toks, 'ald')) AND {_COUNT(anchors.FILM_METHODS)} < 3 THEN 'diversity_suggestions:thin_film_ald_bias'
WHEN {_COUNT(anchors.FILM_METHODS)} >= 2 AND NOT {_CMP} AND NOT contains(low, 'thin film') THEN 'diversity_suggestions:thin_film_missing_comparison_intent' WHEN {_COUNT(anchors.FILM_METHODS)} < 2 AND NOT {_CMP} THEN 'overbroad_queries:thin_film_single_method_query'
WHEN NOT {_HOLDS(anchors.FILM_ANCHORS)} AND NOT {_CMP} THEN 'overbroad_queries:thin_film_missing_method_comparison_anchor' ELSE '' END"""
FILMS_SQL = f"{_HOLDS(('thin film', 'deposition', 'fabrication'))} AND ({_CMP} OR {_COUNT((*anchors.FILM_METHODS, 'physical vapor deposition'))} >= 4)"
_LED = f"SELECT doc_id AS query_id, trim([{quoted(LEADS)}][doc_id % {len(LEADS)} + 1] || ' ' || coalesce(regexp_extract(text, '^\\w*'), '')) AS query, 'planner' AS source FROM documents"


@query(gate_sql(_LED, FILMS, (), CRITIC_SQL, FILMS_SQL))
def query_gate_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries on the topics that the critic knows, with the first word of each document."""
    leads = F.array(*[F.lit(w) for w in LEADS])
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.trim(F.concat(F.get(leads, (F.col("doc_id") % len(LEADS)).cast("int")), F.lit(" "), F.coalesce(F.regexp_extract("text", r"^\w*", 0), F.lit("")))).alias("query"), F.lit("planner").alias("source")
    )
    return _gated(anchors.gate(d, FILMS))


_ANCHORS = f"""WITH {TERMS_SQL}, t AS (SELECT term, n, list_sort(list_distinct({sql_tokens('term')})) AS ws FROM terms), d AS (SELECT doc_id, low, list_distinct({sql_tokens('low')}) AS toks FROM (SELECT doc_id, {_plain_sql('text')} AS low FROM documents)),
m AS (SELECT doc_id, n, len(list_intersect(ws, toks)) AS shared, len(ws) AS size, contains(low, term) AS inside FROM d, t),
k AS (SELECT *, inside OR (size > 0 AND shared = size) AS is_full FROM m WHERE inside OR (size > 0 AND shared = size) OR (size > 2 AND shared >= 2))
SELECT doc_id, count(*) AS n_hits, count(*) FILTER (WHERE is_full) AS n_full, md5(string_agg(n || CASE WHEN is_full THEN '+' ELSE '-' END, ',' ORDER BY n)) AS hits_md5 FROM k GROUP BY doc_id"""


@query(_ANCHORS)
def anchor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hits of all benchmark terms in whole documents by the T-occurrence join."""
    d = table(spark, sf_dir, "documents").select("doc_id", anchors.plain_column("text").alias("low"))
    h = anchors.anchor_hits(d.select("low"), benchmark_terms(spark, sf_dir), "low")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("anchor", "full"))), lambda x: F.concat(x["anchor"].cast("string"), F.when(x["full"], "+").otherwise("-"))), ",")
    per = h.groupBy("key").agg(F.count("*").alias("n_hits"), F.count_if("full").alias("n_full"), F.md5(told).alias("hits_md5"))
    return anchors.join_aggregate(d.select("doc_id", anchors.text_key("low").alias("key")), per, ["key"]).drop("key")


_VARIANTS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN w WHEN 1 THEN upper(substr(w, 1, 4)) WHEN 2 THEN '+\"' || upper(w) || '\"' WHEN 3 THEN w || ' and ' || w WHEN 4 THEN '(' || w || ') OR ' ELSE ['sei', 'LLM', 'Review', '+\"MOF\"', 'AND CO2', '+ai'][doc_id % 6 + 1 + (doc_id // 6) % 6 - 5] END AS q FROM (SELECT doc_id, coalesce(regexp_extract(text, '[A-Za-z]+', 0), '') AS w FROM documents)"
_SHOUT = "regexp_extract_all(translate(q, '\"''+', '   '), '[A-Za-z0-9]+')"


@query(f"""WITH v AS ({_VARIANTS}), s AS (SELECT *, q AS query, {_SHOUT} AS raw, {WORDS_SQL.replace('query', 'q')} FROM v), m AS (SELECT *, list_distinct(list_filter(list_transform(raw, lambda x: lower(x)), lambda x: x NOT IN ('and', 'or', 'not'))) AS ms FROM s)
SELECT doc_id, {LONE} AS lone_word, len(ms) = 1 AND (list_contains([{quoted(anchors.CRITIC_ACRONYMS)}], ms[1]) OR len(list_filter(raw, lambda x: upper(x) = x AND length(x) BETWEEN 2 AND 6)) > 0) AS lone_acronym,
       regexp_matches(q, '^\\+?"?(AI|LLM|MOF|OER|PFM|SEI|SHG)"?$', 'i') AS listed_acronym FROM m""")
def acronym_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the three tests for queries of one acronym, which differ."""
    w, i = F.coalesce(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")), F.col("doc_id")
    some = F.array(*[F.lit(x) for x in ("sei", "LLM", "Review", '+"MOF"', "AND CO2", "+ai")])
    text = (
        F.when(i % 6 == 0, w).when(i % 6 == 1, F.upper(F.substring(w, 1, 4))).when(i % 6 == 2, F.concat(F.lit('+"'), F.upper(w), F.lit('"'))).when(i % 6 == 3, F.concat(w, F.lit(" and "), w))
        .when(i % 6 == 4, F.concat(F.lit("("), w, F.lit(") OR "))).otherwise(F.get(some, (F.floor(i / 6) % 6).cast("int")))
    )
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("q"))
    return d.select("doc_id", anchors.lone_word("q").alias("lone_word"), anchors.lone_acronym("q").alias("lone_acronym"), anchors.listed_acronym("q").alias("listed_acronym"))


# ---- screening after an expansion ---------------------------------------------------------------------------------------


@query(q.SQL["screening_decision"])
def expanded_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All papers screened after a run over four fifths of them; only the contents that are new are assessed."""
    folder = f"{checkpoint_dir(spark)}/quillscreen-{uuid.uuid4().hex}"
    p = papers(spark, sf_dir)
    incremental.assess_missing(p.filter("input_ord % 5 <> 0"), CONTRACT, NOW_YEAR, folder, ROLE_RULES)
    d, _ = incremental.screen_again(p, CONTRACT, NOW_YEAR, folder, role_rules=ROLE_RULES)
    return d.select("paper_id", "decision", "primary_reason", F.array_join("exclusion_reasons", ";").alias("reasons"), F.round("decision_confidence", 6).alias("decision_confidence"), "reading_priority", "suggested_action")


# ---- run evaluation -----------------------------------------------------------------------------------------------------

RUN_PATTERNS = ("public license", "de-la", "42")
METRICS = [*run_metrics.standard_metrics(), *run_metrics.grid()]


def _metrics_sql() -> str:
    e = "title || ' ' || abstract"
    for name, char in tx.ENTITIES.items():
        e = f"replace({e}, {lit(name)}, {lit(char)})"
    e = f"translate(regexp_replace({e}, '<[^>]+>', ' ', 'g'), '{tx.DASHES}\u00a0', '{'-' * len(tx.DASHES)} ')"
    one = lambda w, f: f"regexp_matches({w}, '(^|[^a-z0-9]){f}($|[^a-z0-9])')" if len(f) <= 3 else f"contains({w}, '{f}')"
    found = " OR ".join(one(w, f) for p in RUN_PATTERNS for f in {p, p.replace("-", " ")} for w in ("f", "g"))
    holds = run_metrics.HOLDS | {"negative_term": "negative_matches <> ''", run_metrics.TEXT: found}
    parts = []
    for m in METRICS:
        at = f"({run_metrics.SETS[m.of]})" + (f" AND rank <= {m.top}" if m.top else "")
        hit = at + (f" AND {'NOT ' if m.but_not else ''}coalesce(({holds[m.where]}), false)" if m.where else "")
        if m.measure == run_metrics.MEAN:
            value = f"avg({m.column}) FILTER ({at})"
        elif m.measure == run_metrics.SHARE:
            value = f"count(*) FILTER ({hit}) / nullif(count(*) FILTER ({at}), 0)"
        else:
            value = f"count(*) FILTER ({hit})"
        listed = f"coalesce(string_agg(rank, ',' ORDER BY rank) FILTER ({hit}), '')" if m.measure == run_metrics.RANKS else "NULL"
        parts.append(f"{{'metric': {lit(m.name)}, 'value': CAST(round({value}, 6) AS DOUBLE), 'listed': CAST({listed} AS VARCHAR)}}")
    return o.DECISIONS + f""", t0 AS (SELECT *, {sql_collapsed(f'lower({e})')} AS f FROM decided), t1 AS (SELECT *, replace(f, '-', ' ') AS g FROM t0),
m AS (SELECT question_id, unnest([{', '.join(parts)}]) AS m FROM t1 GROUP BY question_id)
SELECT question_id, m.metric AS metric, m.value AS value, m.listed AS listed FROM m"""


@query(_metrics_sql())
def run_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named metrics of a run and the grid of counts and means, from one pass over the ranked papers."""
    # Means are summed in the order of the ranks, as their last digits depend on it.
    items = q.decided(spark, sf_dir, also=lambda p: run_metrics.marked(p, RUN_PATTERNS, ("title", "abstract")))
    d = run_metrics.evaluate(items.orderBy("rank"), METRICS)
    return run_metrics.long(d).withColumn("value", F.round("value", 6))


# ---- groups of terms ------------------------------------------------------------------------------------------------------

_MINED = """w AS (SELECT regexp_extract_all(lower(text), '[a-z]{2,}') AS w, lang FROM documents WHERE text IS NOT NULL), mined AS (SELECT array_to_string(w[1:2], ' ') AS term, lang = 'en' AS core FROM w WHERE len(w) >= 3
UNION ALL SELECT array_to_string(w[1:3], ' '), false FROM w WHERE len(w) >= 3 UNION ALL SELECT w[1][1] || w[2][1] || w[3][1], false FROM w WHERE len(w) >= 3),
t AS (SELECT term, coalesce(bool_or(core), false) AS required FROM mined GROUP BY term), i AS (SELECT term, array_to_string(list_transform(string_split(term, ' '), lambda x: x[1]), '') AS short FROM t WHERE contains(term, ' ')),
e0 AS (SELECT a.term AS a, b.term AS b FROM t a, t b WHERE a.term <> b.term AND contains(b.term, a.term) UNION SELECT short, term FROM i WHERE short IN (SELECT term FROM t)), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), l0 AS (SELECT term, term AS l FROM t)"""
_ROUNDS = ", ".join(f"l{k} AS (SELECT l.term, least(l.l, coalesce(min(n.l), l.l)) AS l FROM l{k - 1} l LEFT JOIN e ON e.a = l.term LEFT JOIN l{k - 1} n ON n.term = e.b GROUP BY l.term, l.l)" for k in range(1, 25))


@query(f"WITH {_MINED}, {_ROUNDS} SELECT l AS label, count(*) AS n_terms, bool_or(required) AS required, md5(string_agg(term, ';' ORDER BY term)) AS terms_md5 FROM l24 JOIN t USING (term) GROUP BY l")
def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms mined from the beginnings of documents, two and three words and their initials, in groups of aliases."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    d = table(spark, sf_dir, "documents").select(w.alias("w"), (F.col("lang") == "en").alias("core")).filter(F.size("w") >= 3)
    first = lambda n: F.array_join(F.slice("w", 1, n), " ")
    short = F.array_join(F.transform(F.slice("w", 1, 3), lambda x: F.substring(x, 1, 1)), "")
    mined = d.select(F.explode(F.array(F.struct(first(2).alias("term"), "core"), F.struct(first(3).alias("term"), F.lit(False).alias("core")), F.struct(short.alias("term"), F.lit(False).alias("core")))).alias("m")).select("m.*")
    g = term_groups.alias_groups(mined, "term", "core")
    return g.groupBy("label").agg(F.count("*").alias("n_terms"), F.bool_or("group_required").alias("required"), F.md5(F.array_join(F.array_sort(F.collect_list("term")), ";")).alias("terms_md5"))
