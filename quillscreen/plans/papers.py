"""The test tables as papers, and the one question that the example queries ask.

``documents`` has no year, DOI, venue or citations, so deterministic stand-ins take their place, the same in both engines:
title = first sentence, abstract = collapsed text ('' where doc_id % 10 = 7), year = 2000 + doc_id % 27 (null where doc_id % 13 = 0),
venue = source ('' where doc_id % 11 = 0), doi = 10.1000/<doc_id % 200> where doc_id % 3 = 0, citations = n_chars % 500,
provider score = (doc_id % 7) / 5, seeds where doc_id % 97 is 5 (exact) or 6 (manual). The current year is pinned to 2026.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.store import dealt
from quillscreen.plans.contract import Contract, Group

NOW_YEAR = 2026
QUESTION = "was this that there one re des las que die und"
CONTRACT = Contract(
    question=QUESTION, domain="synthetic_prose",
    groups=(Group("core_topic", ("that the", "que la", "und die")), Group("setting_context", ("of the", "de la", "zu der")), Group("method_terms", ("there", "del", "eine"), required=False)),
    forbidden=("gnu general public license",), negative=("worthless", "moron"), positive=("there",),
    aspects=("articles: the; la; die", "links: that this; que el; und das", "numbers: 42; 2024"), must_term_groups=(),
    must_terms=("that", "de"), core_terms=("en",), optional_terms=("fr", "de"), seed_titles=("of the",),
)

#: Role rules with words of the test texts: phrases, a short marker and an acronym.
ROLE_RULES = (
    ("review_background", ("of the", "zu der")), ("theory_mechanism", ("thorough", "that the")), ("in_situ_operando", ("que la",)), ("failure_limitation", ("DER", "worthless")), ("material_case", ("license", "eau")),
    ("conceptual_framework", ("was the",)),
)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))
    # Collapsed once, as a column that the title and the abstract name.
    d = d.withColumn("__whole", tx.collapsed("text"))
    i, whole = F.col("doc_id"), F.col("__whole")
    other = F.lit("")
    return d.select(
        F.lit("q1").alias("question_id"), i.alias("input_ord"), F.concat(F.lit("p"), i.cast("string")).alias("paper_id"), tx.first_sentence(whole, True).alias("title"),
        F.when(i % 10 == 7, other).otherwise(whole).alias("abstract"), F.when(i % 13 != 0, (2000 + i % 27).cast("int")).alias("year"), F.when(i % 11 == 0, other).otherwise(tx.text("source")).alias("venue"),
        F.when(i % 3 == 0, F.concat(F.lit("10.1000/"), (i % 200).cast("string"))).otherwise(other).alias("doi"), (F.col("n_chars") % 500).cast("int").alias("citation_count"), ((i % 7) / 5.0).alias("api_relevance_score"),
        F.when(i % 97 == 5, "seed_exact").when(i % 97 == 6, "manual_seed").otherwise("keyword").alias("source_stage"), F.array("lang").alias("fields_of_study"),
        F.when(i % 2 == 0, "openalex").otherwise("semantic_scholar").alias("source_provider"), F.concat(F.lit("query "), (i % 5).cast("string")).alias("retrieval_query"),
    )


# ---- the same in SQL ---------------------------------------------------------------------------------------------------


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_tokens(e: str) -> str:
    return f"list_filter(regexp_extract_all(lower({e}), '[a-z0-9]+'), lambda k: length(k) > 1 AND k NOT IN ({quoted(tx.STOPWORDS)}))"


def sql_sentences(e: str) -> str:
    return f"list_filter(string_split(regexp_replace({e}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: trim(s) <> '')"


def sql_collapsed(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '\\s+', ' ', 'g'))"


def sql_overlap(tokens: str, question: str = QUESTION) -> str:
    wanted = sorted(set(tx.py_tokens(question)))
    return f"len(list_intersect(list_distinct({tokens}), [{quoted(wanted)}])) / {float(len(wanted))}"


def sql_title_key(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({e}, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"


def sql_clamp(e: str) -> str:
    return f"greatest(0.0, least(1.0, {e}))"


PAPERS = f"""
papers AS (
  SELECT 'q1' AS question_id, doc_id AS input_ord, 'p' || doc_id AS paper_id, coalesce({sql_sentences(sql_collapsed('text'))}[1], '') AS title,
         CASE WHEN doc_id % 10 = 7 THEN '' ELSE {sql_collapsed('text')} END AS abstract, CASE WHEN doc_id % 13 <> 0 THEN CAST(2000 + doc_id % 27 AS INT) END AS year,
         CASE WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(source, '') END AS venue, CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || (doc_id % 200) ELSE '' END AS doi,
         CAST(n_chars % 500 AS INT) AS citation_count, (doc_id % 7) / 5.0 AS api_relevance_score,
         CASE WHEN doc_id % 97 = 5 THEN 'seed_exact' WHEN doc_id % 97 = 6 THEN 'manual_seed' ELSE 'keyword' END AS source_stage, lang,
         CASE WHEN doc_id % 2 = 0 THEN 'openalex' ELSE 'semantic_scholar' END AS source_provider, 'query ' || (doc_id % 5) AS retrieval_query
  FROM documents)"""
