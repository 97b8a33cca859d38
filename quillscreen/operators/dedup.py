"""Deduplication of paper records by DOI, then title, with a merge that fills the gaps of the more complete record.

The merge is an ordered fold: a record joins the group that holds its DOI, else the one that holds its title, and a group's
title follows its most complete record. So groups are not simply the connected components of equal keys, and even records that
agree in both keys can part, when another group takes their title over between them. But records of different components never
meet, so ``deduplicate`` finds the components first, with map-side minima and joins. Components whose groups follow from their
keys alone never leave the JVM: single records, and those in which all share a title or all share a DOI. In the others the fold
runs in record order over a stream of ids: it holds the keys that records share, not the records. A component that needs the
fold is one task, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.store import checkpointed

#: The stages that mark a seed, in the order in which one outweighs all others.
SEED_STAGES = ("manual_seed", "seed_exact", "seed_reference", "seed_citation", "seed_recommendation")
FIRST = ("abstract", "year", "venue", "doi", "url", "seed_relation", "publication_date", "open_access_pdf_url", "tldr")
LARGEST = ("seed_confidence", "citation_count", "api_relevance_score", "openalex_relevance_score", "influential_citation_count", "reference_count")
LISTS = ("authors", "publication_types", "fields_of_study")
JOINED = ("retrieval_provider", "retrieval_stage", "retrieval_query", "seed_paper_id", "seed_title", "seed_reason")


def completeness(d: DataFrame) -> Column:
    """How much of a record is filled in; absent columns count as empty."""
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != "" if c in d.columns else F.lit(False)
    authors = F.least(F.coalesce(F.size("authors"), F.lit(0)), F.lit(5)) if "authors" in d.columns else F.lit(0)
    cites = F.least(F.coalesce("citation_count", F.lit(0)) / 100.0, F.lit(1.0)) if "citation_count" in d.columns else F.lit(0.0)
    score = F.when(have("title"), 2.0).otherwise(0.0) + F.least(F.length(tx.text("abstract")) / 500.0, F.lit(3.0)) + 0.2 * F.greatest(authors, F.lit(0))
    score = score + F.when(have("doi"), 1.0).otherwise(0.0)
    for c in ("url", "venue"):
        score = score + F.when(have(c), 0.5).otherwise(0.0)
    return score + F.when(F.coalesce("year", F.lit(0)) != 0, 0.5).otherwise(0.0) + cites


def keyed(papers: DataFrame) -> DataFrame:
    return papers.withColumns({"doi_key": tx.doi_key("doi"), "title_key": tx.title_key("title"), "completeness": completeness(papers)})


def encoded(papers: DataFrame) -> DataFrame:
    """``input_ord, did, tid, completeness``: keys as the smallest ordinal that has them; ``did`` is -2 without a DOI, ``tid`` -1 without a title.

    Keys that cannot steer the fold go. A title of one record, or only of records with one and the same DOI, is never found by
    title: the first of them meets no such title, and holds the DOI from then on. It counts as no title. A DOI of one record
    is never found either, but a group that has it takes no other, so it stays, as -1.
    """
    rows = keyed(papers).select("input_ord", "doi_key", "title_key", "completeness")
    titles = rows.filter("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("n"), F.min("input_ord").alias("tid"), F.min("doi_key").alias("lo"), F.max("doi_key").alias("hi"))
    titles = titles.filter("n > 1 AND (lo <> hi OR lo = '')").select(F.col("title_key").alias("t"), "tid")
    dois = rows.filter("doi_key <> ''").groupBy("doi_key").agg(F.count("*").alias("n"), F.min("input_ord").alias("did")).filter("n > 1").select(F.col("doi_key").alias("d"), "did")
    # A key of its own for each empty one, so that these do not meet in one task.
    own = lambda c: F.when(F.col(c) == "", F.concat(F.lit("\0"), F.col("input_ord").cast("string"))).otherwise(F.col(c))
    e = rows.withColumns({"kt": own("title_key"), "kd": own("doi_key")}).join(titles, F.col("kt") == F.col("t"), "left").join(dois, F.col("kd") == F.col("d"), "left")
    return e.select("input_ord", F.when(F.col("doi_key") == "", -2).otherwise(F.coalesce("did", F.lit(-1))).cast("long").alias("did"), F.coalesce("tid", F.lit(-1)).cast("long").alias("tid"), "completeness")


def components(rows: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``input_ord, cid`` of the rows of ``encoded`` that share a key: the smallest ordinal reachable over equal keys.

    Each round takes the minimum per key and per record; the rounds end when nothing changes and every one is checkpointed.
    """
    keys = F.array(F.when(F.col("did") >= 0, F.col("did") * 2), F.when(F.col("tid") >= 0, F.col("tid") * 2 + 1))
    shared = rows.select("input_ord", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k"))
    label = shared.groupBy("input_ord").agg(F.min("input_ord").alias("cid")).checkpoint()
    shared = shared.checkpoint()
    for _ in range(max_rounds):
        by_key = shared.join(label, "input_ord").groupBy("k").agg(F.min("cid").alias("m"))
        new = shared.join(by_key, "k").groupBy("input_ord").agg(F.min("m").alias("cid"))
        jump = new.alias("a").join(new.alias("b"), F.col("a.cid") == F.col("b.input_ord")).select(F.col("a.input_ord").alias("input_ord"), F.col("b.cid").alias("cid")).checkpoint()
        changed = jump.alias("a").join(label.alias("b"), "input_ord").filter("a.cid <> b.cid").limit(1).count()
        label = jump
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return label


def with_components(papers: DataFrame) -> DataFrame:
    """The rows of ``encoded`` with ``cid`` and whether the fold is needed: in a component of one title, or of one DOI, all join the first record."""
    rows = checkpointed(encoded(papers))
    rows = rows.join(components(rows), "input_ord", "left").withColumn("cid", F.coalesce("cid", "input_ord"))
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) >= 0)
    mixed = rows.groupBy("cid").agg(F.count("*").alias("n"), (one("did") | one("tid")).alias("one")).filter("n > 1 AND NOT one").select("cid", F.lit(True).alias("fold"))
    return rows.join(mixed, "cid", "left").withColumn("fold", F.coalesce("fold", F.lit(False)))


def groups(papers: DataFrame) -> DataFrame:
    """``input_ord, gid``: the fold's group of each record, named by the ordinal of its first record.

    Only the three values that steer the fold (keys and completeness) travel to it.
    """
    rows = with_components(papers).checkpoint()

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, by_doi, by_title, state = None, {}, {}, {}
        for part in it:
            gids = []
            for cid, o, doi, title, full in zip(*[part[c].tolist() for c in ("cid", "input_ord", "did", "tid", "completeness")], strict=True):
                if cid != current:
                    current, by_doi, by_title, state = cid, {}, {}, {}
                g = by_doi.get(doi)
                if g is None:
                    g = by_title.get(title)
                if g is None:
                    g, state[o] = o, (doi, title, full)
                else:
                    old_doi, old_title, old_full = state[g]
                    # The more complete side lends its title, and its own DOI comes before the other's.
                    if full > old_full:
                        state[g] = (old_doi if doi == -2 else doi, title, full)
                    elif old_doi == -2:
                        state[g] = (doi, old_title, old_full)
                if state[g][0] >= 0:
                    by_doi[state[g][0]] = g
                if state[g][1] >= 0:
                    by_title[state[g][1]] = g
                gids.append(g)
            yield pd.DataFrame({"input_ord": part["input_ord"], "gid": gids})

    native = rows.filter("NOT fold").select("input_ord", F.col("cid").alias("gid"))
    stream = rows.filter("fold").select("cid", "input_ord", "did", "tid", "completeness").repartition("cid").sortWithinPartitions("cid", "input_ord")
    return native.union(stream.mapInPandas(fold, "input_ord long, gid long"))


def merge_groups(papers: DataFrame, gid: str = "gid") -> DataFrame:
    """One row per group, merged field by field around the most complete record, the earliest on ties.

    The base lends identity and title; missing values come from the other records in order; lists are ordered unions of those
    that are not null; numbers take the largest. All aggregates combine map-side: the values of lists by value, so a group gathers its different values only.
    """
    d = keyed(papers)
    order = F.struct((-F.col("completeness")).alias("c"), F.col("input_ord").alias("o"))
    base = [c for c in papers.columns if c not in (*FIRST, *LARGEST, *LISTS, *JOINED, "source_provider", "source_stage", "provider_ids", "semantic_scholar_rank", "input_ord", gid)]
    has = set(papers.columns)
    agg = [F.min("input_ord").alias("input_ord"), F.count("*").alias("n_records")]
    agg += [F.min_by(c, order).alias(c) for c in base]
    for c in (x for x in FIRST if x in has):
        filled = (F.col(c) != 0) if c == "year" else (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
        empty = F.lit(None).cast("int") if c == "year" else F.lit("")
        agg.append(F.coalesce(F.min_by(F.when(filled, F.col(c)), F.when(filled, order)), empty).alias(c))
    agg += [F.max(c).alias(c) for c in LARGEST if c in has]
    agg += [F.count(c).alias(f"__n_{c}") for c in LISTS if c in has]
    if "semantic_scholar_rank" in has:
        agg.append(F.coalesce(F.min(F.when(F.col("semantic_scholar_rank") != 0, F.col("semantic_scholar_rank"))), F.lit(0)).alias("semantic_scholar_rank"))
    merged = d.groupBy(gid).agg(*agg)

    # Values of all lists: of which column, value (of a map also what it maps to), and the first place in the order.
    parts = lambda c: F.filter(F.transform(F.split(tx.text(c), ";"), F.trim), lambda x: x != "")

    def items(c: str) -> Column:
        item = lambda k, i, x: F.struct(F.lit(c).alias("c"), k.cast("string").alias("k"), i.cast("int").alias("i"), x.cast("string").alias("x"))
        if c == "provider_ids":
            found = F.transform(F.map_entries(c), lambda e, i: item(e["key"], i, e["value"]))
        else:
            found = F.transform(F.col(c) if c in LISTS else parts(c), lambda v, i: item(v, i, F.lit(None)))
        return F.coalesce(found, F.array().cast("array<struct<c:string,k:string,i:int,x:string>>"))

    listed = [c for c in (*LISTS, *JOINED, "source_provider", "source_stage", "provider_ids") if c in has]
    if listed:
        e = d.select(gid, order.alias("o"), F.explode(F.concat(*map(items, listed))).alias("v")).select(gid, "v.c", "v.k", F.struct("o", "v.i", "v.x").alias("at"))
        e = e.groupBy(gid, "c", "k").agg(F.min("at").alias("at")).groupBy(gid).agg(*[F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("at", "k")))).alias(f"__v_{c}") for c in listed])
        merged = merged.join(e, gid, "left")
    values = {c: F.coalesce(F.transform(f"__v_{c}", lambda x: x["k"]), F.array().cast("array<string>")) for c in listed}
    for c in listed:
        if c in LISTS:
            values[c] = F.when(F.col(f"__n_{c}") > 0, values[c])
        elif c in JOINED:
            values[c] = F.array_join(values[c], ";")
        elif c == "source_provider":
            values[c] = F.array_join(F.array_sort(values[c]), ";")
        elif c == "source_stage":
            stages, values[c] = values[c], F.array_join(values[c], ";")
            for s in reversed(SEED_STAGES):
                values[c] = F.when(F.array_contains(stages, s), s).otherwise(values[c])
        else:
            values[c] = F.coalesce(F.map_from_entries(F.transform(f"__v_{c}", lambda x: F.struct(x["k"], x["at"]["x"]))), F.create_map().cast("map<string,string>"))
    return merged.withColumns(values).select(gid, "n_records", *papers.drop(gid).columns)


def deduplicate(papers: DataFrame) -> DataFrame:
    """Merged papers; ``input_ord`` of the first record keeps the order of first sight."""
    return merge_groups(papers.join(groups(papers), "input_ord")).drop("gid")


def exact_key_groups(papers: DataFrame) -> DataFrame:
    """Fast form: records that agree in the DOI, or without one in the title, are a group; native and without rounds."""
    d = keyed(papers)
    key = F.when(F.col("doi_key") != "", F.concat(F.lit("d:"), "doi_key")).when(F.col("title_key") != "", F.concat(F.lit("t:"), "title_key")).otherwise(F.concat(F.lit("o:"), F.col("input_ord").cast("string")))
    return d.groupBy(key.alias("dedup_key")).agg(F.min("input_ord").alias("gid"), F.count("*").alias("n_records"))
