"""Atom feeds of preprints, read entry by entry with Spark's XML functions.

The text reader cuts the files at the end tags of entries, so a feed of any size is read by many tasks, and each entry is parsed on its own, so a bad one spoils no other
(a reader of row tags stops at the first). Prefixes of namespaces are dropped, as feeds
choose them freely. Entries that are no XML, or lack an id or a title, are kept aside with what is wrong with them and their text.

Defined cases: an entry without authors, categories, a summary or a date is a paper with empty ones; a date that is none leaves the year null; repeated
entries each count; white space in titles and summaries is collapsed; a folder without entries gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.sources import providers

BAD = "__bad"
ENTRY = f"id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>, doi string, journal_ref string, {BAD} string"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry; ``__bad`` is the text of one that could not be parsed."""
    parts = spark.read.option("lineSep", "</entry>").text(path)
    # What follows the last entry of a file holds none; an entry without an end is one with the next, and no XML.
    found = parts.select(F.regexp_extract("value", r"(?s)<entry[\s>].*", 0).alias("e")).filter("e <> ''")
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return found.select(F.from_xml(F.concat("e", F.lit("</entry>")), ENTRY, options).alias("x")).select("x.*")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The papers of the feeds in ``path``, and ``defect, entry`` of the entries that are none."""
    d = entries(spark, path)
    blank = lambda c: F.trim(tx.text(c)) == ""
    defect = F.when(F.col(BAD).isNotNull(), "malformed").when(blank("id"), "no id").when(blank("title"), "no title")
    d = d.withColumn("defect", defect)
    good = d.filter("defect IS NULL").withColumns({"author": F.coalesce("author", F.array().cast("array<struct<name:string>>")), "category": F.coalesce("category", F.array().cast("array<struct<_term:string>>")), "summary": tx.text("summary"), "published": tx.text("published")})
    papers = providers.arxiv(good, keep=("doi",))
    aside = d.filter("defect IS NOT NULL").select("defect", F.coalesce(BAD, F.to_json(F.struct(*[c for c in d.columns if c not in (BAD, "defect")]))).alias("entry"))
    return papers, aside
