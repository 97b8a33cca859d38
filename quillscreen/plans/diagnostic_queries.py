"""Queries of the run diagnostics and of the provider payloads, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators import diagnostics, provenance, snowball
from quillscreen.operators.store import checkpoint_dir
from quillscreen.plans import oracle as o
from quillscreen.plans import papers as pp
from quillscreen.plans import queries as q
from quillscreen.plans import screening
from quillscreen.plans.papers import papers, quoted, sql_collapsed, sql_title_key, sql_tokens
from quillscreen.sources import feeds, importers, providers, retrieval, rows, sinks
from quillscreen.streaming import run_log

FROM_PAPERS, query, table = q.FROM_PAPERS, q.query, q.table
PATTERNS = ("public license", "de la", "that-the", "der", "la", "2024")


def _pattern_sql() -> str:
    v = "text"
    for name, char in tx.ENTITIES.items():
        v = f"replace({v}, {o.lit(name)}, {o.lit(char)})"
    v = f"translate(regexp_replace({v}, '<[^>]+>', ' ', 'g'), '{tx.DASHES} ', '{'-' * len(tx.DASHES)} ')"
    tests = []
    for p in PATTERNS:
        forms = tx.unique([p, p.replace("-", " ")])
        one = lambda w, f: f"regexp_matches({w}, '(^|[^a-z0-9]){f}($|[^a-z0-9])')" if len(f) <= 3 else f"contains({w}, '{f}')"
        tests.append(f"CASE WHEN {' OR '.join(one(w, f) for w in ('f', 'g') for f in forms)} THEN '{p}' END")
    return f"""WITH n AS (SELECT doc_id, {sql_collapsed(f'lower({v})')} AS f FROM documents), m AS (SELECT doc_id, f, replace(f, '-', ' ') AS g FROM n)
SELECT doc_id, array_to_string(list_filter([{', '.join(tests)}], lambda v: v IS NOT NULL), ';') AS matched FROM m"""


@query(_pattern_sql())
def forbidden_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patterns found in each text."""
    d = diagnostics.matched_patterns(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", PATTERNS)
    return d.select("doc_id", F.array_join("matched", ";").alias("matched"))


@query(FROM_PAPERS + """, n AS (SELECT *, row_number() OVER (PARTITION BY source_provider, retrieval_query ORDER BY input_ord) AS n FROM papers)
SELECT source_provider, retrieval_query, count(*) AS raw_count, md5(array_to_string(list(title ORDER BY input_ord) FILTER (WHERE n <= 5), '|')) AS titles_md5 FROM n GROUP BY 1, 2""")
def retrieval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each provider and query brought."""
    d = diagnostics.retrieval_diagnostics(papers(spark, sf_dir))
    return d.select("source_provider", "retrieval_query", "raw_count", F.md5(F.array_join("top_titles", "|")).alias("titles_md5"))


@query(o.DECISIONS + "SELECT question_id, CASE WHEN is_seed THEN 'seed' ELSE source_stage END AS lane, count(*) AS n_papers, count(*) FILTER (WHERE false_positive_penalty > 0) AS n_penalised, array_to_string(list(paper_id ORDER BY rank), ';') AS paper_ids FROM decided WHERE rank <= 20 GROUP BY 1, 2")
def ranking_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of the first papers."""
    return diagnostics.lane_diagnostics(q.decided(spark, sf_dir)).withColumn("paper_ids", F.array_join("paper_ids", ";"))


_PAIRS = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
AXES, QUERY_ANCHORS = (("the", "que"), ("that",)), {"articles": ("the", "der"), "license": ("public license",), "none": ("zzzz",)}


@query(FROM_PAPERS + f""", t AS (SELECT title, lower(title) AS low, list_filter(string_split({sql_collapsed('lower(title)')}, ' '), lambda x: x <> '') AS t, {sql_tokens('title')} AS k FROM papers),
f AS (SELECT title, low, len(list_distinct(k)) < 3 OR len(list_distinct({_PAIRS})) < len({_PAIRS}) OR coalesce(list_max(map_values(list_histogram(t))), 0) >= 3 OR (contains(low, 'the') OR contains(low, 'que'))::INT + contains(low, 'that')::INT <= 1 AS bad FROM t),
a AS (SELECT count(*) AS n_queries, count(DISTINCT title) FILTER (WHERE bad) AS n_bad, (bool_or(contains(low, 'the') OR contains(low, 'der'))::INT + bool_or(contains(low, 'public license'))::INT + bool_or(contains(low, 'zzzz'))::INT) / 3.0 AS c FROM f)
SELECT n_queries, n_bad, CAST(round(c, 4) AS DOUBLE) AS anchor_coverage, CAST(round(0.6 * c + 0.4 * (1 - n_bad / n_queries), 4) AS DOUBLE) AS query_quality_score FROM a""")
def query_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the queries as one score; titles stand for query texts."""
    return diagnostics.query_quality(papers(spark, sf_dir), "title", AXES, QUERY_ANCHORS)


def _bundles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, u = table(spark, sf_dir, "events"), F.col("user_id") % 50
    b = e.select(F.col("event_type").alias("provider"), F.when(F.col("event_type") == "click", 0).otherwise(F.round("value").cast("long") % 3).alias("returned"), F.when(u == 0, 429).when((u == 1) & (F.col("event_type") != "view"), 500).alias("status_code"), F.lit("").alias("error"))
    return b, e.groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("requested"))


STATES = """b AS (SELECT event_type AS provider, CASE WHEN event_type = 'click' THEN 0 ELSE CAST(round(value) AS BIGINT) % 3 END AS returned, CASE WHEN user_id % 50 = 0 THEN 429 WHEN user_id % 50 = 1 AND event_type <> 'view' THEN 500 END AS code FROM events),
s AS (SELECT provider, sum(returned) AS returned, count(code) AS errors, coalesce(bool_or(code = 429), false) AS rl FROM b GROUP BY provider),
st AS (SELECT provider, CASE WHEN rl AND returned > 0 THEN 'partial_success_rate_limited' WHEN rl THEN 'rate_limited' WHEN errors > 0 AND returned > 0 THEN 'partial_success' WHEN errors > 0 THEN 'failed' WHEN returned > 0 THEN 'success' ELSE 'success_no_results' END AS status FROM s)"""


@query(f"WITH {STATES} SELECT CAST(avg((status NOT IN ({quoted(diagnostics.FATAL)}))::INT) AS DOUBLE) AS provider_success_rate, count(*) FILTER (WHERE status IN ({quoted(diagnostics.FATAL)})) AS provider_error_count FROM st")
def provider_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate and errors of the providers; event types stand for providers."""
    return diagnostics.provider_rates(provenance.provider_status(*_bundles(spark, sf_dir)))


@query("""WITH a AS (SELECT event_type AS provider, event_id AS attempt, CASE WHEN user_id % 50 = 0 THEN 429 ELSE 200 END AS code, CASE WHEN user_id % 100 = 0 THEN 'Rate limit reached' ELSE '' END AS error FROM events),
s AS (SELECT provider, min(attempt) AS stop FROM a WHERE code = 429 AND contains(lower(error), 'rate limit') GROUP BY provider)
SELECT provider, count(*) AS n_attempts, max(attempt) AS last_attempt FROM a LEFT JOIN s USING (provider) WHERE stop IS NULL OR attempt <= stop GROUP BY provider""")
def stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each provider up to the one that stops it."""
    u = F.col("user_id")
    a = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("event_id").alias("attempt"), F.when(u % 50 == 0, 429).otherwise(200).alias("status_code"), F.when(u % 100 == 0, "Rate limit reached").otherwise("").alias("error"))
    return diagnostics.before_stop(a).groupBy("provider").agg(F.count("*").alias("n_attempts"), F.max("attempt").alias("last_attempt"))


@query(FROM_PAPERS + " SELECT paper_id, CAST(0 AS INT) AS source_ord, input_ord AS row_ord FROM papers WHERE source_stage <> 'keyword' UNION ALL SELECT paper_id, 1, input_ord FROM papers WHERE source_stage = 'keyword' UNION ALL SELECT 'd' || doc_id, 2, doc_id FROM documents WHERE lang = 'en'")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, then retrieved, then imported papers."""
    p = papers(spark, sf_dir).select("paper_id", "input_ord", "source_stage")
    imported = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"), F.col("doc_id").alias("input_ord"))
    return diagnostics.ordered_union(p.filter("source_stage <> 'keyword'").drop("source_stage"), p.filter("source_stage = 'keyword'").drop("source_stage"), imported)


@query(FROM_PAPERS + f""", x AS (SELECT 0 AS s, input_ord AS o, {sql_collapsed('retrieval_query')} AS t FROM papers UNION ALL SELECT 1, input_ord, upper({sql_collapsed('retrieval_query')}) FROM papers UNION ALL SELECT 2, input_ord, {sql_collapsed('venue')} FROM papers),
f AS (SELECT lower(t) AS k, min({{'s': s, 'o': o, 't': t}}) AS x FROM x WHERE t <> '' GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY x) AS INT) AS pos, x.t AS suggestion FROM f ORDER BY x LIMIT 12""")
def next_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to search next; queries and venues stand for the sources of suggestions."""
    p = papers(spark, sf_dir)
    one = lambda c: p.select(F.col("input_ord").alias("ord"), c.alias("suggestion"))
    return diagnostics.next_searches([one(F.col("retrieval_query")), one(F.upper("retrieval_query")), one(F.col("venue"))])


_REPAIRS = [(0, "openalex", "query 0", "drop", ""), (1, "openalex", "query 1", "repair", "query one"), (2, "openalex", "unknown", "repair", "query two"), (3, "crossref", "query 3", "keep", ""), (4, "openalex", "other", "repair", "QUERY 3")]


@query(f"""WITH {q.PLANNED}, sg AS (SELECT * FROM (VALUES {', '.join(str(r) for r in _REPAIRS)}) v(ord, provider, original_query, recommendation, repaired_query)),
u AS (SELECT p.provider, 0 AS part, p.ord, CASE WHEN coalesce(s.repaired_query, '') <> '' THEN s.repaired_query ELSE p.query END AS query FROM planned p LEFT JOIN sg s ON s.provider = p.provider AND s.original_query = p.query WHERE coalesce(s.recommendation, '') <> 'drop'
UNION ALL SELECT provider, 1, ord, repaired_query FROM sg WHERE recommendation = 'repair' AND repaired_query <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY provider, lower(query) ORDER BY part, ord) AS n FROM u)
SELECT provider, query, CAST(row_number() OVER (PARTITION BY provider ORDER BY part, ord) AS INT) AS pos FROM n WHERE n = 1""")
def query_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair suggestions applied to the planned queries."""
    s = spark.createDataFrame(_REPAIRS, "ord long, provider string, original_query string, recommendation string, repaired_query string")
    return diagnostics.repaired_queries(q._planned(spark), s)


@query(FROM_PAPERS + " SELECT 'k' || (input_ord % 50) AS paper_id, max(input_ord) AS input_ord, arg_max(source_stage, input_ord) AS source_stage FROM papers WHERE input_ord % 50 < 20 GROUP BY 1")
def last_paper_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last paper of each id that a pilot names."""
    p = papers(spark, sf_dir).select(F.concat(F.lit("k"), (F.col("input_ord") % 50).cast("string")).alias("paper_id"), "input_ord", "source_stage")
    ids = spark.range(20).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("paper_id")).union(spark.createDataFrame([("absent",)], "paper_id string"))
    return diagnostics.last_by_id(p, ids)


@query(FROM_PAPERS + """, kd AS (SELECT * FROM (VALUES ('reference', 0), ('citation', 1), ('recommendation', 2)) v(kind, k)),
e AS (SELECT s.paper_id AS src, kind, 'p' || ((s.input_ord * 7 + k * 3 + pos * 2 + 1) % (SELECT count(*) FROM papers)) AS dst FROM papers s, kd, range(1, 6) r(pos))
SELECT kind, count(*) AS n_edges, count(DISTINCT dst) AS n_targets FROM e WHERE dst IN (SELECT paper_id FROM papers WHERE abstract <> '') GROUP BY kind""")
def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation edges whose paper survived; papers without an abstract did not."""
    _, edges, p = q._graph(spark, sf_dir)
    return diagnostics.kept_edges(edges, p.filter("abstract <> ''")).groupBy("kind").agg(F.count("*").alias("n_edges"), F.count_distinct("dst_paper_id").alias("n_targets"))


@query(FROM_PAPERS + f""", c AS (SELECT doi, {sql_title_key('title')} AS t FROM papers WHERE input_ord % 2 = 0), s AS (SELECT input_ord, CASE WHEN input_ord % 2 = 0 THEN doi ELSE '' END AS doi, {sql_title_key('upper(title)')} AS t FROM papers),
r AS (SELECT (doi <> '' AND doi IN (SELECT doi FROM c)) OR (t <> '' AND t IN (SELECT t FROM c)) AS ok FROM s)
SELECT count(*) AS seed_count, count(*) FILTER (WHERE ok) AS resolved_count, count(*) FILTER (WHERE NOT ok) AS unresolved_count FROM r""")
def resolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many seeds were resolved; every paper is a seed, the even ones are the catalogue."""
    p = papers(spark, sf_dir)
    s = p.select(F.col("input_ord").alias("seed_ord"), F.when(F.col("input_ord") % 2 == 0, F.col("doi")).otherwise("").alias("doi"), F.upper("title").alias("title"))
    return diagnostics.resolution_report(snowball.resolve(s, p.filter("input_ord % 2 = 0")))


@query(o.DECISIONS + "SELECT rank, paper_id, CAST(round(final, 3) AS DOUBLE) AS score, decision, reading_priority, CASE WHEN support_level = 'missing_abstract' THEN 'uncertain' WHEN final >= 0.5 AND aspect_coverage_score >= 0.4 THEN 'include' WHEN final < 0.2 THEN 'exclude' ELSE 'uncertain' END AS card_action FROM decided WHERE rank <= 12")
def paper_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: evidence cards of the first papers."""
    return diagnostics.paper_cards(q.decided(spark, sf_dir, "title")).select("rank", "paper_id", "score", "decision", "reading_priority", "card_action")


@query("""WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN '  ' || props || ' ' WHEN 2 THEN '[' || props || ']' ELSE 'Sure: ' || props END AS a FROM events),
v AS (SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'json_not_object' WHEN 3 THEN 'invalid_json' ELSE '' END AS error_type, props FROM events)
SELECT event_id, error_type, CASE WHEN error_type = '' THEN json_extract_string(props, '$.' || json_keys(props)[1]) END AS first_value FROM v""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, padded, listed and broken JSON answers, read safely."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id") % 4
    a = F.when(i == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i == 1, F.concat(F.lit("  "), "props", F.lit(" "))).when(i == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit("Sure: "), "props"))
    d = diagnostics.parsed_answer(e.select("event_id", a.alias("answer")), "answer")
    m = F.from_json(F.to_json("data"), "map<string,string>")
    return d.select("event_id", "error_type", F.get(F.map_values(m), F.lit(0)).alias("first_value"))


# ---- provider payloads ---------------------------------------------------------------------------------------------------


@query(FROM_PAPERS + f"""SELECT 'openalex:W' || input_ord AS paper_id, title, {sql_collapsed('title')} AS abstract, year, venue, doi, CAST(citation_count AS INT) AS citation_count, api_relevance_score AS api_relevance_score, coalesce(lang, '') AS fields FROM papers WHERE title <> ''""")
def openalex_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers from OpenAlex-shaped JSON with an inverted-index abstract, written here from the test papers."""
    p = papers(spark, sf_dir)
    words = p.select("paper_id", F.posexplode(F.filter(F.split(tx.collapsed("title"), " "), lambda x: x != "")).alias("pos", "word"))
    index = words.groupBy("paper_id", "word").agg(F.collect_list("pos").alias("at")).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    p = p.join(index, "paper_id", "left")
    work = F.struct(
        F.concat(F.lit("W"), F.col("input_ord").cast("string")).alias("id"), F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), F.upper("doi"))).alias("doi"), F.col("title").alias("display_name"), F.col("index").alias("abstract_inverted_index"),
        F.col("year").alias("publication_year"), F.col("citation_count").alias("cited_by_count"), F.col("api_relevance_score").alias("relevance_score"), F.struct(F.col("venue").alias("display_name")).alias("host_venue"), F.array(F.struct(F.element_at("fields_of_study", 1).alias("display_name"))).alias("concepts"),
    )
    bronze = p.select(F.to_json(F.struct(F.array(work).alias("results"))).alias("payload"))
    return providers.openalex(bronze).select("paper_id", "title", "abstract", "year", "venue", "doi", "citation_count", "api_relevance_score", F.array_join("fields_of_study", ";").alias("fields"))


@query(FROM_PAPERS + """SELECT 's2:' || input_ord AS paper_id, title, year, venue, doi, CASE WHEN input_ord % 2 = 0 THEN 1.0 ELSE 0.5 END AS api_relevance_score, CAST(citation_count AS INT) AS citation_count, md5(abstract) AS abstract_md5 FROM papers WHERE title <> ''""")
def semantic_scholar_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers from Semantic-Scholar-shaped JSON; every other paper is the second hit of its response."""
    p, i = papers(spark, sf_dir), F.col("input_ord")
    hit = F.struct(i.cast("string").alias("paperId"), "title", "abstract", "year", "venue", F.col("citation_count").alias("citationCount"), F.when(F.col("doi") != "", F.create_map(F.lit("DOI"), F.upper("doi"))).alias("externalIds"))
    none = F.lit(None).cast("string")
    blank = F.struct(F.lit("0").alias("paperId"), F.lit("").alias("title"), none.alias("abstract"), F.lit(None).cast("int").alias("year"), none.alias("venue"), F.lit(None).cast("int").alias("citationCount"), F.lit(None).cast("map<string,string>").alias("externalIds"))
    bronze = p.select(F.to_json(F.struct(F.when(i % 2 == 0, F.array(hit)).otherwise(F.array(blank, hit)).alias("data"))).alias("payload"))
    return providers.semantic_scholar(bronze).select("paper_id", "title", "year", "venue", "doi", "api_relevance_score", "citation_count", F.md5("abstract").alias("abstract_md5"))


@query(FROM_PAPERS + """SELECT 'crossref:' || doi AS paper_id, title, year, venue, doi, CAST(citation_count AS INT) AS citation_count FROM papers WHERE title <> ''""")
def crossref_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers from Crossref-shaped JSON; the year comes from the first dated part."""
    p = papers(spark, sf_dir)
    dated = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts")))
    item = F.struct(F.array("title").alias("title"), F.upper("doi").alias("DOI"), F.array("venue").alias("container-title"), dated.alias("issued"), F.col("citation_count").alias("is-referenced-by-count"))
    bronze = p.select(F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("payload"))
    return providers.crossref(bronze).select("paper_id", "title", "year", "venue", "doi", "citation_count")


@query(FROM_PAPERS + """, w AS (SELECT paper_id, substr(sha256(lower(source_provider) || '|' || trim(retrieval_query || ' ' || input_ord) || '|10|'), 1, 24) AS k FROM papers)
SELECT paper_id, k AS cache_key FROM w WHERE k NOT IN (SELECT substr(sha256(lower(source_provider) || '|' || trim(retrieval_query || ' ' || input_ord) || '|10|'), 1, 24) FROM papers WHERE abstract = '')""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned requests without a stored response; papers without an abstract have one."""
    p = papers(spark, sf_dir)
    key = providers.cache_key(F.upper("source_provider"), F.concat_ws(" ", "retrieval_query", F.col("input_ord").cast("string")), F.lit(10), F.lit(None))
    w = p.select("paper_id", "abstract", key.alias("cache_key"))
    return providers.misses(w.drop("abstract"), w.filter("abstract = ''"))


# ---- honest figures of whole runs ----------------------------------------------------------------------------------------

@query(f"WITH {STATES}, {pp.PAPERS}, c AS (SELECT count(*) FILTER (WHERE status NOT IN ('failed', 'rate_limited', 'not_attempted')) AS ok, count(*) FILTER (WHERE status NOT IN ('success', 'success_no_results', 'not_attempted')) AS bad FROM st), m AS (SELECT count(DISTINCT CASE WHEN doi = '' THEN paper_id ELSE doi END) AS merged FROM papers) SELECT CASE WHEN ok > 0 AND bad > 0 THEN 'partial_success' WHEN ok > 0 AND merged > 0 THEN 'success' ELSE 'failed' END AS retrieval_status, ok > 0 AND merged > 0 AS ranked_papers_based_on_real_retrieval, CASE WHEN ok > 0 AND (bad > 0 OR merged > 0) THEN '' ELSE 'insufficient_screened_papers' END AS reason FROM c, m")
def retrieval_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: what all provider states amount to, with the counted papers of the run."""
    key = F.when(F.col("doi") == "", F.col("paper_id")).otherwise(F.col("doi"))
    merged = papers(spark, sf_dir).agg(F.count_distinct(key)).first()[0]
    return provenance.retrieval_context(provenance.provider_status(*_bundles(spark, sf_dir)), merged, merged, 5)


# ---- libraries and label files: written by the query, read back by the importers ------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/imports-{uuid.uuid4().hex}"


_PLAIN_SQL = "trim(regexp_replace(regexp_replace(title, '[{}\"\\\\]', '', 'g'), '\\s+', ' ', 'g'))"


@query(FROM_PAPERS + f""", t AS (SELECT {_PLAIN_SQL} AS title, year, venue, doi FROM papers), s AS (SELECT * FROM (VALUES ('imported_bibtex'), ('imported_ris'), ('imported_csv')) v(source_provider))
SELECT source_provider, title, year, venue, doi FROM t, s WHERE title <> ''""")
def library_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test papers as BibTeX, RIS and CSV libraries, read back."""
    p = papers(spark, sf_dir).select(tx.collapsed(F.regexp_replace("title", r'[{}"\\]', "")).alias("title"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), "venue", "doi", "input_ord")
    base, out = _folder(spark), []
    bib = F.concat(F.lit("@article{k"), F.col("input_ord").cast("string"), *[x for f, c in (("title", "title"), ("year", "year"), ("journal", "venue"), ("doi", "doi")) for x in (F.lit(f",\n  {f} = {{"), F.col(c), F.lit("}"))], F.lit("\n}"))
    ris = F.concat(F.lit("TY  - JOUR"), *[x for f, c in (("TI", "title"), ("PY", "year"), ("JO", "venue"), ("DO", "doi")) for x in (F.lit(f"\n{f}  - "), F.col(c))], F.lit("\nER  - "))
    for name, value in (("bib", bib), ("ris", ris)):
        p.select(value.alias("value")).write.text(f"{base}/{name}")
    sinks.write_csv(p, f"{base}/csv", ["title", "year", "venue", "doi"])
    for read, name in ((importers.read_bibtex, "bib"), (importers.read_ris, "ris"), (importers.read_csv, "csv")):
        out.append(read(spark, f"{base}/{name}")[0].select("source_provider", "title", "year", "venue", "doi"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id)
SELECT 'p' || doc_id AS paper_id, CASE WHEN t = 1 THEN 'exclude' WHEN q = 1 THEN 'include' ELSE 'uncertain' END AS label, CAST(CASE WHEN doc_id % 5 = 0 THEN 0.25 WHEN t = 1 THEN -0.20 WHEN q = 1 THEN 0.10 ELSE 0.0 END AS DOUBLE) AS adjustment, CASE WHEN t = 1 THEN 'exclude' WHEN q = 1 THEN 'include' ELSE 'odd, "label"' END AS note FROM l""")
def feedback_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feedback file with labels in mixed case, unknown labels and some adjustments, written and read back."""
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))  # noqa: E741
    label = F.when(F.col("t") == 1, " Exclude ").when(F.col("q") == 1, "INCLUDE").otherwise('odd, "label"')
    d = l.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paper_id"), label.alias("label"), F.when(F.col("doc_id") % 5 == 0, "0.25").otherwise("").alias("adjustment"), F.lower(F.trim(label)).alias("note"))
    path = _folder(spark)
    sinks.write_csv(d, path, ["paper_id", "label", "adjustment", "note"])
    return importers.read_feedback(spark, path)


@query(FROM_PAPERS + """SELECT paper_id, title, '' AS authors, coalesce(CAST(year AS VARCHAR), '') AS year, venue, doi, '' AS url, source_provider, '' AS retrieval_provider, '' AS retrieval_stage, retrieval_query, source_stage, '' AS seed_paper_id, '' AS seed_title, '' AS seed_reason, '' AS seed_relation,
CASE WHEN input_ord % 4 = 0 THEN '' ELSE printf('%.4f', (input_ord % 4) / 8.0) END AS seed_confidence, CAST(citation_count AS VARCHAR) AS citation_count FROM papers""")
def paper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: papers as flat rows of the CSV set."""
    return rows.paper_rows(papers(spark, sf_dir).withColumn("seed_confidence", (F.col("input_ord") % 4) / 8.0))


@query(o.with_(pp.PAPERS, o.EVIDENCE) + """SELECT paper_id, title, evidence_sentence AS claim, evidence_sentence, printf('%.4f', keyword_overlap) AS keyword_overlap, support_level, CASE WHEN support_level = 'strict_support' THEN 'true' ELSE 'false' END AS strict_span_validated, CASE WHEN support_level = 'missing_abstract' THEN 'true' ELSE 'false' END AS missing_abstract FROM ev""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: evidence and verification as flat rows."""
    d = rows.evidence_rows(screening.with_evidence(papers(spark, sf_dir), q.QUESTION))
    return d.select("paper_id", "title", "claim", "evidence_sentence", "keyword_overlap", "support_level", "strict_span_validated", "missing_abstract")


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2), s AS (SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS stages FROM n GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS k FROM events WHERE ts IS NOT NULL)
SELECT CAST(user_id AS VARCHAR) AS run, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(*) AS n_masked, any_value(stages) AS stages, min(ts) AS first_ts, max(ts) AS last_ts,
       max('{"event":"' || event_id || '","session_token":"[redacted]"}') FILTER (WHERE k = 1) AS last_details FROM l JOIN s USING (user_id) GROUP BY user_id""")
def run_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11, K9, S25, A25: the event log as a stateful stream, stopped in the middle and continued; every tenth event is delivered twice."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    log = e.select(
        F.col("user_id").cast("string").alias("run"), F.col("event_id").cast("string").alias("event_id"), "ts", F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.col("event_type").alias("stage"),
        F.lit("message").alias("message"), F.create_map(F.lit("session_token"), F.concat(F.lit("secret"), F.col("user_id").cast("string")), F.lit("event"), F.col("event_id").cast("string")).alias("details"), (F.col("event_id") % 10 == 0).alias("twice"),
    )
    log = log.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("twice", "copy")
    middle = e.select(F.timestamp_micros(F.percentile_approx(F.unix_micros("ts"), 0.5))).first()[0]
    base = f"{checkpoint_dir(spark)}/quillscreen-{uuid.uuid4().hex}"
    for part in (log.filter(F.col("ts") < F.lit(middle)), log.filter(F.col("ts") >= F.lit(middle))) if middle else (log,):
        run_log.write(part, f"{base}/log")
        run_log.follow(run_log.read(spark, f"{base}/log"), f"{base}/summaries", f"{base}/state")
    d = run_log.latest(spark, f"{base}/summaries").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})
    return d.withColumn("stages", F.array_join(F.transform(F.array_sort(F.map_entries("stages")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";"))


_ASKED = """a AS (SELECT DISTINCT coalesce(source, '') AS s, coalesce(lang, '') AS l FROM documents), r AS (SELECT s, l, trim(s || ' ' || l) AS q, unnest([{'p': 'openalex', 'm': 'keyword', 'g': 'openalex_keyword'}, {'p': 'openalex', 'm': 'semantic', 'g': 'openalex_semantic'}, {'p': 'semantic_scholar', 'm': 'keyword', 'g': 'semantic_scholar'}]) AS x FROM a)"""


@query(f"""WITH {_ASKED}, d AS (SELECT coalesce(source, '') AS s, coalesce(lang, '') AS l, doc_id, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT s, l, x.p AS p, string_agg(CASE x.p WHEN 'openalex' THEN 'openalex:W' ELSE 's2:' END || doc_id, ';' ORDER BY doc_id) AS ids, count(*) AS n_papers, count(*) FILTER (WHERE x.p = 'openalex' OR n % 2 = 0) AS n_missing_abstract FROM d JOIN r USING (s, l) WHERE n <= 25 AND x.m = 'keyword' AND l <> 'es' GROUP BY 1, 2, 3)
SELECT x.p AS provider, x.g AS stage, q AS query, x.m = 'keyword' AND r.l <> 'es' AS cached, CASE WHEN x.m = 'keyword' AND r.l <> 'es' THEN '' ELSE 'ConnectionError' END AS error, coalesce(CASE WHEN x.m = 'keyword' THEN n_papers END, 0) AS n_papers, coalesce(CASE WHEN x.m = 'keyword' THEN n_missing_abstract END, 0) AS n_missing_abstract,
       CASE WHEN x.m = 'keyword' THEN ids END AS ids, CASE WHEN x.m = 'keyword' AND n_papers > 0 THEN x.p || '|' || x.g || '|' || q || '|keyword' END AS stamped FROM r LEFT JOIN k ON r.s = k.s AND r.l = k.l AND r.x.p = k.p WHERE q <> ''""")
def retrieval_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests planned from the hosts and languages of documents, answered from recorded payloads of 25 results at most.

    The recorded answers leave out semantic searches and one language, whose requests reach the data source and come back as error rows.
    """
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("s"), F.coalesce("lang", F.lit("")).alias("l"), "doc_id", F.col("text").isNotNull().alias("some"))
    each = F.explode(F.array(*[F.lit(p) for p in ("openalex", "semantic_scholar")])).alias("provider")
    asked = d.select("s", "l").distinct().select("s", "l", each, F.trim(F.concat_ws(" ", "s", "l")).alias("query"), F.lit(25).alias("max_results"), F.lit(None).cast("int").alias("from_year"))
    first = d.filter("some").withColumn("n", F.row_number().over(Window.partitionBy("s", "l").orderBy("doc_id"))).filter("n <= 25")
    i = F.col("doc_id").cast("string")
    openalex = F.to_json(F.struct(F.concat(F.lit("W"), i).alias("id"), F.concat(F.lit("Title "), i).alias("title")))
    scholar = F.to_json(F.struct(i.alias("paperId"), F.concat(F.lit("Title "), i).alias("title"), F.when(F.col("n") % 2 == 1, "text").alias("abstract")))
    items = lambda item: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))), lambda x: x["x"]), ",")
    answers = first.groupBy("s", "l").agg(items(openalex).alias("o"), items(scholar).alias("h"))
    keyed = retrieval.plan(asked).filter("search_mode = 'keyword' AND query NOT LIKE '% es' AND query <> 'es'")
    named = asked.select("s", "l", "provider", "query").join(answers, ["s", "l"]).drop("s", "l")
    payload = F.when(F.col("provider") == "openalex", F.concat(F.lit('{"results":['), "o", F.lit("]}"))).otherwise(F.concat(F.lit('{"data":['), "h", F.lit("]}")))
    path = f"{checkpoint_dir(spark)}/quillscreen-{uuid.uuid4().hex}"
    keyed.join(named, ["provider", "query"]).withColumn("payload", payload).select(*retrieval.REQUEST, "payload").write.parquet(path)
    papers_, told = retrieval.retrieve(asked, path, {"openalex": retrieval.Offline(), "semantic_scholar": retrieval.Offline()})
    stamped = F.concat_ws("|", "retrieval_provider", "retrieval_stage", "retrieval_query", "source_stage")
    number = F.regexp_extract("paper_id", "[0-9]+$", 0).cast("long")
    ids = papers_.groupBy("cache_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("k"), "paper_id"))), lambda x: x["paper_id"]), ";").alias("ids"), F.max(stamped).alias("stamped"))
    out = told.filter("query <> ''").join(ids, "cache_key", "left")
    return out.select("provider", F.col("retrieval_stage").alias("stage"), "query", "cached", "error", "n_papers", "n_missing_abstract", "ids", "stamped")


_ENTRY = "lpad(CAST(doc_id AS VARCHAR), 9, '0')"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')[1:4] AS w, lang, md5(coalesce(text, '')) AS m FROM documents)
SELECT 'arxiv:2401.' || {_ENTRY} AS paper_id, array_to_string(w, ' ') AS title, m AS abstract, 'First & Author;Second <' || doc_id || '>' AS authors, CASE WHEN doc_id % 13 <> 0 THEN 2000 + doc_id % 27 END AS year, CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || doc_id % 200 ELSE '' END AS doi,
       'cs.' || coalesce(upper(lang), 'NONE') || ';math' AS fields, '' AS defect FROM d WHERE doc_id % 37 <> 5 AND len(w) > 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'malformed:' || {_ENTRY} FROM d WHERE doc_id % 37 = 5 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no title:' || {_ENTRY} FROM d WHERE doc_id % 37 <> 5 AND len(w) = 0""")
def arxiv_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Atom feed written from documents and read back, with its namespaces; entries with crossed tags and without a title are kept aside."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.slice(F.regexp_extract_all(tx.text("text"), F.lit("[A-Za-z]+"), F.lit(0)), 1, 4).alias("w"), "lang", F.md5(tx.text("text")).alias("m"))
    i, number = F.col("doc_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0")
    tag = lambda name, v: F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name.split()[0]}>"))
    author = lambda v: tag("author", tag("name", v))
    broken = F.when(i % 37 == 5, "<title>crossed</summary>").otherwise("")
    entry = tag("entry", F.concat(
        tag("id", F.concat(F.lit("http://arxiv.org/abs/2401."), number, F.lit("v2"))), broken, tag("title", F.concat(F.lit("  "), F.array_join("w", "\n   "))), tag("summary", F.col("m")),
        tag("published", F.when(i % 13 != 0, F.concat((2000 + i % 27).cast("string"), F.lit("-05-01T10:00:00Z"))).otherwise("unknown")), author(F.lit("First &amp; Author")), author(F.concat(F.lit("Second &lt;"), i.cast("string"), F.lit("&gt;"))),
        F.when(i % 3 == 0, tag('arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom"', F.concat(F.lit("10.1000/"), (i % 200).cast("string")))).otherwise(""),
        F.lit('<category term="cs.'), F.coalesce(F.upper("lang"), F.lit("NONE")), F.lit('"/><category term="math"/>'),
    ))
    path = f"{checkpoint_dir(spark)}/quillscreen-{uuid.uuid4().hex}"
    d.select(F.regexp_replace(entry, "\n", " ").alias("value")).write.text(path)
    good, bad = feeds.read(spark, path)
    none = F.lit(None).cast("string")
    shown = good.select("paper_id", "title", "abstract", F.array_join("authors", ";").alias("authors"), "year", "doi", F.array_join("fields_of_study", ";").alias("fields"), F.lit("").alias("defect"))
    aside = bad.select(*[none.alias(c) for c in ("paper_id", "title", "abstract", "authors")], F.lit(None).cast("int").alias("year"), none.alias("doi"), none.alias("fields"), F.concat_ws(":", "defect", F.regexp_extract("entry", r"2401\.([0-9]{9})", 1)).alias("defect"))
    return shown.unionByName(aside)
