"""One-hop expansion of seed papers along citation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscreen.functions import text as tx

#: Edge kinds in the order in which they are followed.
KINDS = ("reference", "citation", "recommendation")
CONFIDENCE = 0.8


def paper_key(doi="doi", title="title"):
    """Normalised DOI, else normalised title; null without either."""
    d, t = tx.doi_key(doi), tx.title_key(title)
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(t != "", F.concat(F.lit("title:"), t))


def expand(seeds: DataFrame, edges: DataFrame, catalog: DataFrame, existing: DataFrame, top_n: int = 3) -> DataFrame:
    """New papers reached from the first ``top_n`` seeds: the first ``top_n`` neighbours of each kind, none that is known already.

    ``seeds``: seed_ord, paper_id, title. ``edges``: src_paper_id, dst_paper_id, kind, pos. The cut to top_n comes before the
    test for known papers. A paper reached twice is kept for the first seed, kind and position. A paper without key is never known.
    """
    first = seeds.orderBy("seed_ord").limit(top_n).select("seed_ord", F.col("paper_id").alias("seed_paper_id"), F.col("title").alias("seed_title"))
    near = edges.join(F.broadcast(first), F.col("src_paper_id") == F.col("seed_paper_id"))
    near = near.withColumn("__n", F.row_number().over(Window.partitionBy("seed_paper_id", "kind").orderBy("pos"))).filter(F.col("__n") <= top_n)
    rows = near.select("seed_ord", "seed_paper_id", "seed_title", "kind", "pos", "dst_paper_id").join(catalog, F.col("dst_paper_id") == F.col("paper_id")).drop("dst_paper_id").withColumn("__key", paper_key())
    known = existing.select(paper_key().alias("__known")).filter("__known IS NOT NULL").distinct()
    rows = rows.join(known, F.col("__key") == F.col("__known"), "left_anti")
    kind_ord = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    again = Window.partitionBy(F.coalesce("__key", F.concat(F.lit("row:"), F.col("seed_paper_id"), F.lit("|"), "kind", F.lit("|"), F.col("pos").cast("string")))).orderBy("seed_ord", kind_ord, "pos")
    rows = rows.withColumn("__first", F.row_number().over(again)).filter("__first = 1")
    stage = F.concat(F.lit("seed_"), F.col("kind"))
    reason = F.concat(F.lit("Found via "), stage, F.lit(" expansion from seed '"), "seed_title", F.lit("'."))
    return rows.select(*catalog.columns, "seed_paper_id", "seed_title", stage.alias("source_stage"), F.col("kind").alias("seed_relation"), reason.alias("seed_reason"), F.lit(CONFIDENCE).alias("seed_confidence"))


def seed_type(value):
    """doi, openalex, semantic_scholar or title, by the look of a seed's identifier."""
    v = F.trim(tx.text(value))
    return (
        F.when(v.rlike(r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)?10\.[0-9]{4,9}/\S+$"), "doi").when(v.rlike(r"(?i)^(https?://openalex\.org/)?W[0-9]+$"), "openalex")
        .when(v.rlike(r"^(s2:.+|[0-9a-f]{40})$"), "semantic_scholar").otherwise("title")
    )


def resolve(seeds: DataFrame, catalog: DataFrame) -> DataFrame:
    """Seeds with the catalogue paper that has their DOI, else their title; unresolved ones stay as manual seeds of confidence 0.75."""
    c = catalog.select(F.col("paper_id").alias("found_id"), tx.doi_key("doi").alias("__d"), tx.title_key("title").alias("__t"), F.col("input_ord").alias("__o"))
    by_doi = c.filter("__d <> ''").groupBy("__d").agg(F.min_by("found_id", "__o").alias("by_doi"))
    by_title = c.filter("__t <> ''").groupBy("__t").agg(F.min_by("found_id", "__o").alias("by_title"))
    d = seeds.withColumns({"__sd": tx.doi_key("doi"), "__st": tx.title_key("title")})
    d = d.join(by_doi, F.col("__sd") == F.col("__d"), "left").join(by_title, F.col("__st") == F.col("__t"), "left")
    found = F.coalesce("by_doi", "by_title")
    return d.select(*seeds.columns, found.alias("paper_id"), F.when(found.isNotNull(), "seed_exact").otherwise("manual_seed").alias("source_stage"), F.when(found.isNotNull(), 1.0).otherwise(0.75).alias("seed_confidence"))
