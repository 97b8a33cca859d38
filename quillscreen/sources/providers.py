"""Normalisation of provider payloads to papers: four services, each a projection over its JSON or XML.

Payloads are columns, so a bronze table of raw responses becomes a silver table of papers in one scan; ``keep`` names columns of the bronze table
that each paper carries on. No network is used here; a fetcher (``sources.retrieval``) writes the bronze table, keyed by ``cache_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import text as tx

OPENALEX = "struct<results:array<struct<id:string,doi:string,title:string,display_name:string,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,publication_year:int,publication_date:string,type:string,cited_by_count:int,relevance_score:double,primary_location:struct<source:struct<display_name:string>,landing_page_url:string,pdf_url:string>,host_venue:struct<display_name:string>,open_access:struct<oa_url:string>,concepts:array<struct<display_name:string>>,topics:array<struct<display_name:string>>>>>"
SEMANTIC_SCHOLAR = "struct<data:array<struct<paperId:string,title:string,abstract:string,authors:array<struct<name:string>>,year:int,venue:string,citationCount:int,influentialCitationCount:int,referenceCount:int,url:string,externalIds:map<string,string>,fieldsOfStudy:array<string>,s2FieldsOfStudy:array<struct<category:string>>,publicationTypes:array<string>,publicationDate:string,openAccessPdf:struct<url:string>,tldr:struct<text:string>>>>"
CROSSREF = "struct<message:struct<items:array<struct<title:array<string>,DOI:string,URL:string,abstract:string,`container-title`:array<string>,author:array<struct<given:string,family:string>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>,type:string,`is-referenced-by-count`:int,subject:array<string>>>>>"


def cache_key(provider: Column, query: Column, max_results: Column, from_year: Column) -> Column:
    """Content address of a response: 24 hex digits over all that shapes it."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", F.lower(part(provider)), F.trim(part(query)), part(max_results), part(from_year)), 256), 1, 24)


def misses(wanted: DataFrame, cached: DataFrame, key: str = "cache_key") -> DataFrame:
    """Planned requests without a stored response."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


def abstract_of(index: Column) -> Column:
    """Text of an inverted index: words by position, gaps dropped; of several words at one position the last entry stands."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    order = F.sort_array(entries)
    # Each entry beside the next one: a look-up of the array inside a lambda would sort it anew for every entry.
    last = F.zip_with(order, F.slice(order, F.lit(2), F.size(order)), lambda x, y: F.when(y["p"].eqNullSafe(x["p"]), None).otherwise(x["w"]))
    return F.coalesce(F.array_join(last, " "), F.lit(""))


def _names(array: Column, field: str) -> Column:
    return F.filter(F.transform(F.coalesce(array, F.array()), lambda x: F.trim(F.coalesce(x[field], F.lit("")))), lambda x: x != "")


def _first(*cols: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c) for c in cols], F.lit(""))


def openalex(bronze: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    r = bronze.select(*keep, F.posexplode(F.from_json(payload, OPENALEX)["results"]).alias("hit", "r"))
    c = lambda p: F.col(f"r.{p}")
    authors = F.filter(F.transform(F.coalesce(c("authorships"), F.array()), lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), lambda x: x != "")
    return r.select(
        *keep, F.concat(F.lit("openalex:"), c("id")).alias("paper_id"), _first(c("title"), c("display_name")).alias("title"), abstract_of(c("abstract_inverted_index")).alias("abstract"), authors.alias("authors"), c("publication_year").alias("year"),
        _first(c("primary_location.source.display_name"), c("host_venue.display_name")).alias("venue"), tx.doi_key(c("doi")).alias("doi"), _first(c("primary_location.landing_page_url"), c("id")).alias("url"), F.lit("openalex").alias("source_provider"),
        F.create_map(F.lit("openalex"), c("id")).alias("provider_ids"), F.coalesce(c("cited_by_count"), F.lit(0)).alias("citation_count"), F.coalesce(c("relevance_score"), F.lit(0.0)).alias("api_relevance_score"), F.coalesce(c("relevance_score"), F.lit(0.0)).alias("openalex_relevance_score"),
        F.coalesce(c("publication_date"), F.lit("")).alias("publication_date"), F.array_distinct(F.concat(_names(c("concepts"), "display_name"), _names(c("topics"), "display_name"))).alias("fields_of_study"), _first(c("open_access.oa_url"), c("primary_location.pdf_url")).alias("open_access_pdf_url"),
    ).filter("title <> ''")


def semantic_scholar(bronze: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """The relevance of a hit is one over its rank."""
    r = bronze.select(*keep, F.posexplode(F.from_json(payload, SEMANTIC_SCHOLAR)["data"]).alias("hit", "r"))
    c = lambda p: F.col(f"r.{p}")
    none = F.array().cast("array<string>")
    ids = F.map_concat(F.create_map(F.lit("semantic_scholar"), c("paperId")), F.coalesce(F.transform_keys(c("externalIds"), lambda k, v: F.lower(k)), F.create_map().cast("map<string,string>")))
    return r.select(
        *keep, F.concat(F.lit("s2:"), c("paperId")).alias("paper_id"), F.coalesce(c("title"), F.lit("")).alias("title"), F.coalesce(c("abstract"), F.lit("")).alias("abstract"), _names(c("authors"), "name").alias("authors"), c("year").alias("year"), F.coalesce(c("venue"), F.lit("")).alias("venue"),
        tx.doi_key(F.element_at(F.coalesce(c("externalIds"), F.create_map().cast("map<string,string>")), "DOI")).alias("doi"), F.coalesce(c("url"), F.lit("")).alias("url"), F.lit("semantic_scholar").alias("source_provider"), ids.alias("provider_ids"), F.coalesce(c("citationCount"), F.lit(0)).alias("citation_count"),
        (F.lit(1.0) / (F.col("hit") + 1)).alias("api_relevance_score"), (F.col("hit") + 1).alias("semantic_scholar_rank"), F.coalesce(c("publicationDate"), F.lit("")).alias("publication_date"), F.coalesce(c("publicationTypes"), none).alias("publication_types"),
        F.array_distinct(F.concat(F.coalesce(c("fieldsOfStudy"), none), _names(c("s2FieldsOfStudy"), "category"))).alias("fields_of_study"), F.coalesce(c("influentialCitationCount"), F.lit(0)).alias("influential_citation_count"), F.coalesce(c("referenceCount"), F.lit(0)).alias("reference_count"),
        F.coalesce(c("openAccessPdf.url"), F.lit("")).alias("open_access_pdf_url"), F.coalesce(c("tldr.text"), F.lit("")).alias("tldr"),
    ).filter("title <> ''")


def crossref(bronze: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    r = bronze.select(*keep, F.posexplode(F.from_json(payload, CROSSREF)["message"]["items"]).alias("hit", "r"))
    c = lambda p: F.col(f"r.{p}")
    year = F.coalesce(*[F.get(F.get(c(f"`{p}`.`date-parts`"), F.lit(0)), F.lit(0)) for p in ("published-print", "published-online", "published", "issued")])
    authors = F.filter(F.transform(F.coalesce(c("author"), F.array()), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda x: x != "")
    return r.select(
        *keep, F.concat(F.lit("crossref:"), tx.doi_key(c("DOI"))).alias("paper_id"), F.coalesce(F.get(c("title"), F.lit(0)), F.lit("")).alias("title"), tx.strip_html(c("abstract")).alias("abstract"), authors.alias("authors"), year.alias("year"), F.coalesce(F.get(c("`container-title`"), F.lit(0)), F.lit("")).alias("venue"),
        tx.doi_key(c("DOI")).alias("doi"), F.coalesce(c("URL"), F.lit("")).alias("url"), F.lit("crossref").alias("source_provider"), F.coalesce(c("`is-referenced-by-count`"), F.lit(0)).alias("citation_count"), F.coalesce(c("subject"), F.array().cast("array<string>")).alias("fields_of_study"),
    ).filter("title <> ''")


def arxiv(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``entries`` as Spark's XML reader gives them with rowTag ``entry``: id, title, summary, published, author, category; ``keep`` can name ``doi``."""
    kinds = dict(entries.dtypes)
    people = F.transform("author", lambda a: a["name"]) if kinds["author"].startswith("array") else F.array(F.col("author.name"))
    terms = F.transform("category", lambda a: a["_term"]) if kinds["category"].startswith("array") else F.array(F.col("category._term"))
    return entries.select(
        F.concat(F.lit("arxiv:"), F.regexp_extract("id", r"([^/]+?)(v[0-9]+)?$", 1)).alias("paper_id"), tx.collapsed("title").alias("title"), tx.collapsed("summary").alias("abstract"), people.alias("authors"), F.substring(F.col("published").cast("string"), 1, 4).try_cast("int").alias("year"),
        F.lit("arXiv").alias("venue"), (tx.doi_key("doi") if "doi" in keep else F.lit("")).alias("doi"), F.col("id").alias("url"), F.lit("arxiv").alias("source_provider"), F.substring(F.col("published").cast("string"), 1, 10).alias("publication_date"), terms.alias("fields_of_study"),
    ).filter("title <> ''")
