"""Retrieval behind one protocol: planned requests as a Python data source, stored responses first, and provenance on every paper.

A client is anything with ``search(query, max_results, from_year, ...)`` that gives a provider's payload as a dictionary; it is only called for requests whose
response is not stored yet. Each of those is one partition of the data source, so requests run side by side and a lost executor repeats
its own. A client that raises, or answers with an error, gives an error row; errors are not stored, so the next run asks again. No client with a
network is part of this library.

A filter on the year of a read of the source reaches the client, which can leave older papers out on the provider's side. Error rows have no year and so pass
no such filter; ``retrieve`` bounds years through the requests instead and keeps them.

Defined cases: requests that repeat are sent once; a blank query or a limit of zero or less is planned but never sent; null years are unbounded; an unknown
provider is an error. The planned requests of one run pass through the driver, MOST_REQUESTS at most.
"""

from __future__ import annotations

import base64
import inspect
import json
import sys
from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition

from quillscreen.functions import text as tx
from quillscreen.operators.provenance import planned_stages
from quillscreen.operators.store import checkpointed
from quillscreen.sources import providers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT, MOST_REQUESTS = "planned_requests", 10_000
REQUEST = ("cache_key", "provider", "query", "search_mode", "retrieval_stage", "max_results", "from_year")
HIT = "cache_key string, provider string, query string, search_mode string, retrieval_stage string, max_results int, from_year int, hit int, item string, year int, error string, error_message string"
BRONZE = "cache_key string, provider string, query string, search_mode string, retrieval_stage string, max_results int, from_year int, payload string"
#: Where each provider's payload has its results, and the part of a result that holds its year.
RESULTS = {"openalex": (("results",), "publication_year"), "semantic_scholar": (("data",), "year"), "crossref": (("message", "items"), "year")}
NORMALISERS: dict[str, Callable[..., DataFrame]] = {"openalex": providers.openalex, "semantic_scholar": providers.semantic_scholar, "crossref": providers.crossref}
PUSH = "spark.sql.python.filterPushdown.enabled"


class Client(Protocol):
    """One provider."""

    def search(self, query: str, max_results: int, from_year: int | None = None, sort_mode: str = "relevance", search_mode: str = "keyword") -> Mapping[str, Any]: ...


class Offline:
    """A client that has no answer: what is not stored becomes an error row."""

    def search(self, query: str, max_results: int, from_year: int | None = None) -> Mapping[str, Any]:
        raise ConnectionError("no stored response and no network")


def call(client: Client, query: str, max_results: int, from_year: int | None, **more: Any) -> Mapping[str, Any]:
    """``client.search`` with those of the further arguments that it takes."""
    wanted = inspect.signature(client.search).parameters
    anything = any(p.kind is p.VAR_KEYWORD for p in wanted.values())
    return client.search(query, max_results, from_year, **{k: v for k, v in more.items() if anything or k in wanted})


class Planned(InputPartition):
    """One request."""

    def __init__(self, request: dict[str, Any], from_year: int | None) -> None:
        self.request, self.from_year = request, from_year


class PlannedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.requests = json.loads(options["requests"])
        self.clients = options["clients"]
        self.from_year: int | None = None

    def pushFilters(self, filters: list[Any]) -> Iterator[Any]:  # noqa: N802  (Spark's name)
        """Lower bounds of the year go to the clients; Spark still checks every row, as a client may ignore them."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("year",) and isinstance(f.value, int):
                least = f.value + isinstance(f, GreaterThan)
                self.from_year = least if self.from_year is None else max(self.from_year, least)
            yield f

    def partitions(self) -> list[Planned]:
        return [Planned(r, self.from_year) for r in self.requests]

    def read(self, partition: Planned) -> Iterator[tuple]:
        r = partition.request
        bounds = [y for y in (r["from_year"], partition.from_year) if y is not None]
        at = tuple(r[k] for k in REQUEST)
        try:
            client = cloudpickle.loads(base64.b64decode(self.clients))[r["provider"]]
            payload = call(client, r["query"], r["max_results"], max(bounds, default=None), search_mode=r["search_mode"], sort_mode="relevance")
            if payload.get("error"):
                yield (*at, None, None, None, str(payload["error"]), str(payload.get("error_message", ""))[:500])
                return
            path, year = RESULTS[r["provider"]]
            for step in path[:-1]:
                payload = payload.get(step) or {}
            found = (payload.get(path[-1]) or [])[: r["max_results"]]
            rows = [(*at, n, json.dumps(item, ensure_ascii=False), item.get(year) if isinstance(item.get(year), int) else None, None, None) for n, item in enumerate(found)]
        except Exception as e:  # an answer that cannot be had is a row, not the end of the run
            rows = [(*at, None, None, None, type(e).__name__, str(e)[:500])]
        # A request without results still has a row, so that its empty answer is stored.
        yield from rows or [(*at, -1, None, None, None, None)]


class PlannedRequests(DataSource):
    """``spark.read.format("planned_requests")``: one row per result of each request."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return HIT

    def reader(self, schema: Any) -> PlannedReader:
        return PlannedReader(self.options)


def plan(requests: DataFrame, openalex_mode: str = "keyword+semantic") -> DataFrame:
    """The columns REQUEST of distinct requests: ``provider, query, max_results, from_year`` once per retrieval stage, with the key of its response."""
    one = requests.select(F.lower(tx.text("provider")).alias("provider"), tx.collapsed("query").alias("query"), F.coalesce("max_results", F.lit(0)).cast("int").alias("max_results"), F.col("from_year").cast("int").alias("from_year"))
    d = planned_stages(one.distinct(), openalex_mode)
    key = providers.cache_key(F.concat_ws("_", "provider", "search_mode"), F.col("query"), F.col("max_results"), F.col("from_year"))
    return d.withColumn("cache_key", key).select(*REQUEST)


def scan(spark: SparkSession, requests: list[dict[str, Any]], clients: Mapping[str, Client]) -> DataFrame:
    """The data source over requests with the columns REQUEST."""
    unknown = {r["provider"] for r in requests} - (set(clients) & set(RESULTS))
    if unknown:
        raise ValueError(f"unknown provider: {', '.join(sorted(unknown))}")
    # A reader that takes filters needs this setting of its session for as long as the scan can run.
    spark.conf.set(PUSH, "true")
    spark.dataSource.register(PlannedRequests)
    return spark.read.format(FORMAT).option("requests", json.dumps(requests)).option("clients", base64.b64encode(cloudpickle.dumps(dict(clients))).decode()).load()


def responses(hits: DataFrame) -> DataFrame:
    """BRONZE rows of the hits of requests that had no error: the results of each, in order, as the provider's payload."""
    wrap = {"openalex": ('{"results":[', "]}"), "semantic_scholar": ('{"data":[', "]}"), "crossref": ('{"message":{"items":[', "]}}")}
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("hit", "item")))), lambda x: x["item"]), ",")
    per = hits.groupBy(*REQUEST).agg(items.alias("items"), F.bool_or(F.col("error").isNotNull()).alias("failed")).filter("NOT failed")
    head, tail = F.lit(""), F.lit("")
    for provider, (a, b) in wrap.items():
        head, tail = F.when(F.col("provider") == provider, a).otherwise(head), F.when(F.col("provider") == provider, b).otherwise(tail)
    return per.select(*REQUEST, F.concat(head, "items", tail).alias("payload"))


def stamp(papers: DataFrame, provider: str = "__provider", stage: str = "__stage", query: str = "__query", mode: str = "__mode") -> DataFrame:
    """Provenance where a paper has none yet: provider, stage and query of its request, and whether the search was semantic."""
    have = lambda c: tx.text(c) if c in papers.columns else F.lit("")
    fill = lambda c, v: F.when(have(c) == "", v).otherwise(have(c))
    filled = {"retrieval_provider": F.col(provider), "retrieval_stage": F.col(stage), "retrieval_query": F.col(query), "source_stage": F.when(F.col(mode) == "semantic", "semantic").otherwise("keyword")}
    return papers.withColumns({c: fill(c, v) for c, v in filled.items()}).drop(provider, stage, query, mode)


def bronze(spark: SparkSession, path: str) -> DataFrame:
    """The stored responses; none where the folder does not exist yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], BRONZE)
    return spark.read.schema(BRONZE).parquet(path)


def retrieve(requests: DataFrame, path: str, clients: Mapping[str, Client], openalex_mode: str = "keyword+semantic") -> tuple[DataFrame, DataFrame]:
    """Papers of all requests with their provenance, and one row per planned request: ``n_papers, n_missing_abstract, cached, error, error_message``.

    Responses are read from the bronze table at ``path`` and those that are missing are fetched and appended to it. A paper that several requests
    bring has a row for each.
    """
    spark = requests.sparkSession
    planned = checkpointed(plan(requests, openalex_mode))
    asked = planned.filter("max_results > 0 AND query <> ''")
    stored = bronze(spark, path).dropDuplicates(["cache_key"])
    missing = [r.asDict() for r in providers.misses(asked, stored).limit(MOST_REQUESTS + 1).collect()]
    if len(missing) > MOST_REQUESTS:
        raise ValueError(f"more than {MOST_REQUESTS} requests are not stored yet; plan fewer in one run")
    failed = spark.createDataFrame([], "cache_key string, error string, error_message string")
    known = stored.select("cache_key", F.lit(True).alias("cached"))
    if missing:
        known = checkpointed(known)
        hits = checkpointed(scan(spark, missing, clients))
        responses(hits).write.mode("append").parquet(path)
        failed = hits.filter("error IS NOT NULL").select("cache_key", "error", "error_message")
        stored = bronze(spark, path).dropDuplicates(["cache_key"])
    answered = asked.select(*REQUEST).join(stored.select("cache_key", "payload"), "cache_key")
    rows = answered.select("cache_key", F.col("provider").alias("__provider"), F.col("retrieval_stage").alias("__stage"), F.col("query").alias("__query"), F.col("search_mode").alias("__mode"), "payload")
    keep = ("cache_key", "__provider", "__stage", "__query", "__mode")
    parts = [normalise(rows.filter(F.col("__provider") == name), keep=keep) for name, normalise in NORMALISERS.items()]
    papers = parts[0]
    for part in parts[1:]:
        papers = papers.unionByName(part, allowMissingColumns=True)
    counts = papers.groupBy("cache_key").agg(F.count("*").alias("n_papers"), F.count_if(tx.text("abstract") == "").alias("n_missing_abstract"))
    told = planned.join(counts, "cache_key", "left").join(known, "cache_key", "left").join(failed, "cache_key", "left")
    told = told.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_papers", "n_missing_abstract")}).withColumns({"cached": F.coalesce("cached", F.lit(False)), "error": F.coalesce("error", F.lit("")), "error_message": F.coalesce("error_message", F.lit(""))})
    return stamp(papers), told
