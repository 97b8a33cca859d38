"""Readers of user libraries and label files: BibTeX, RIS, CSV, seeds, feedback and gold labels.

Files are read by Spark, so any path that Spark can read works. Records without a title are returned apart by the readers of
libraries, as (source, record number, reason).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.snowball import seed_type

FORMATS = {"bib": "bibtex", "bibtex": "bibtex", "ris": "ris", "csv": "csv"}
#: Header names of each field, in order of preference.
ALIASES = {
    "title": ("title", "paper_title", "article_title"), "abstract": ("abstract", "summary", "description"), "author": ("authors", "author", "creators"), "year": ("year", "publication_year", "pub_year"),
    "date": ("date", "publication_date"), "journal": ("journal", "journal_name", "source_title", "publication"), "venue": ("venue", "booktitle", "conference"), "doi": ("doi",), "url": ("url", "link"),
    "citation_count": ("citation_count", "citations", "cited_by_count"), "keywords": ("keywords", "tags", "fields_of_study"), "publication_type": ("publication_type", "type", "item_type"),
}
#: RIS tags of each field, in order of preference.
RIS_TAGS = {"title": ("TI", "T1", "CT"), "abstract": ("AB", "N2"), "year": ("PY", "Y1", "DA"), "venue": ("JO", "JF", "T2", "JA"), "doi": ("DO",), "url": ("UR",), "publication_type": ("TY",)}
FIELDS = ("title", "abstract", "author", "year", "date", "journal", "venue", "doi", "url", "citation_count", "keywords", "publication_type")
RECORD = "source string, record int, " + ", ".join(f"`{f}` string" for f in FIELDS)


def detect_format(path: str, requested: str = "auto") -> str:
    """bibtex, ris or csv, as asked for or by the suffix."""
    wanted = (requested or "auto").strip().lower()
    if wanted != "auto" and wanted not in FORMATS:
        raise ValueError(f"unsupported import format: {requested}")
    found = FORMATS.get(wanted) or FORMATS.get(PurePosixPath(path).suffix.lower().lstrip("."))
    if not found:
        raise ValueError("the format cannot be told from the file name; name bibtex, ris or csv")
    return found


def papers_from_metadata(records: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """Paper rows and rejected records of a table with FIELDS, all strings."""
    v = {f: tx.metadata_value(f) for f in FIELDS}
    first = lambda *fs: F.coalesce(*[F.when(v[f] != "", v[f]) for f in fs], F.lit(""))
    d = records.select("source", "record", v["title"].alias("title"), v["abstract"].alias("abstract"), tx.people(v["author"]).alias("authors"), tx.first_year(first("year", "date")).alias("year"), first("venue", "journal").alias("venue"), tx.doi_key(v["doi"]).alias("doi"), v["url"].alias("url"), tx.to_int(v["citation_count"]).alias("citation_count"), v["date"].alias("publication_date"), F.filter(F.array(v["publication_type"]), lambda x: x != "").alias("publication_types"), F.filter(F.transform(F.split(v["keywords"], ";"), F.trim), lambda x: x != "").alias("fields_of_study"))
    key = F.when(F.col("doi") != "", F.col("doi")).otherwise(F.concat(tx.title_key("title"), F.lit("::"), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    good = d.filter("title <> ''").select(F.concat(F.lit("imported:"), F.substring(F.sha1(key), 1, 12)).alias("paper_id"), *[c for c in d.columns if c not in ("source", "record")], F.lit(provider).alias("source_provider"))
    return good, d.filter("title = ''").select("source", "record", F.lit("missing title").alias("reason"))


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A library with any of the header names of ALIASES, in any case; the first non-empty one counts."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    by_lower = {c.lower(): c for c in reversed(raw.columns)}

    def pick(names: tuple[str, ...]) -> Column:
        have = [tx.metadata_value(F.col(f"`{by_lower[n]}`")) for n in names if n in by_lower]
        return F.coalesce(*[F.when(c != "", c) for c in have], F.lit("")) if have else F.lit("")

    rows = raw.select(F.lit(path).alias("source"), (F.monotonically_increasing_id() + 1).cast("int").alias("record"), *[pick(ALIASES[f]).alias(f) for f in FIELDS])
    return papers_from_metadata(rows, "imported_csv")


def bibtex_records(text: str) -> Iterator[dict[str, str]]:
    """Entries of a BibTeX file: type and fields, with braces and quotes balanced by depth."""
    at = 0
    while m := re.compile(r"@(\w+)\s*[{(]").search(text, at):
        depth, i, quoted = 1, m.end(), False
        while i < len(text) and depth:
            c = text[i]
            depth += (c in "{(") - (c in "})")
            i += 1
        body, at = text[m.end() : i - 1], i
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        fields = {"publication_type": m[1].lower()}
        for f in re.finditer(r"([A-Za-z][\w-]*)\s*=\s*", body):
            j, depth, quoted = f.end(), 0, False
            while j < len(body) and (depth or quoted or body[j] != ","):
                c = body[j]
                quoted ^= c == '"' and not depth
                depth += (c == "{") - (c == "}")
                j += 1
            fields.setdefault(f[1].lower(), body[f.end() : j].strip())
        yield fields


def ris_records(text: str) -> Iterator[dict[str, list[str]]]:
    """Records of a RIS file as tag lists; a line without a tag continues the last one."""
    now: dict[str, list[str]] = {}
    last = ""
    for line in text.splitlines():
        m = re.match(r"^([A-Z][A-Z0-9])  - ?(.*)$", line)
        if m and m[1] == "ER":
            if now:
                yield now
            now, last = {}, ""
        elif m:
            if m[1] == "TY" and now:
                yield now
                now = {}
            last = m[1]
            now.setdefault(last, []).append(m[2].strip())
        elif last and line.strip():
            now[last][-1] = f"{now[last][-1]} {line.strip()}"
    if now:
        yield now


def _bibtex_row(f: dict[str, str]) -> dict[str, str]:
    out = {k: f.get(k, "") for k in FIELDS}
    return out | {"venue": f.get("venue") or f.get("booktitle") or "", "keywords": f.get("keywords", "").replace(",", ";")}


def _ris_row(r: dict[str, list[str]]) -> dict[str, str]:
    first = lambda tags: next((v for t in tags for v in r.get(t, []) if v), "")
    out = dict.fromkeys(FIELDS, "") | {k: first(t) for k, t in RIS_TAGS.items()}
    return out | {"author": " ; ".join(r.get("AU", []) + r.get("A1", [])), "keywords": ";".join(r.get("KW", []))}


def _read_parsed(spark: SparkSession, path: str, parse, row, provider: str) -> tuple[DataFrame, DataFrame]:
    """One file is one row, and files are parsed side by side."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for source, text in zip(part["path"], part["value"], strict=True):
                rows = [{"source": source, "record": n} | row(r) for n, r in enumerate(parse(text), 1)]
                yield pd.DataFrame(rows, columns=["source", "record", *FIELDS])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return papers_from_metadata(files.mapInPandas(run, RECORD), provider)


def read_bibtex(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read_parsed(spark, path, bibtex_records, _bibtex_row, "imported_bibtex")


def read_ris(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read_parsed(spark, path, ris_records, _ris_row, "imported_ris")


def read_library(spark: SparkSession, path: str, requested: str = "auto") -> tuple[DataFrame, DataFrame]:
    return {"bibtex": read_bibtex, "ris": read_ris, "csv": read_csv}[detect_format(path, requested)](spark, path)


def _last_per_paper(rows: DataFrame) -> DataFrame:
    """The last line of each paper counts; the line order is that of the file."""
    d = rows.withColumn("__line", F.monotonically_increasing_id()).withColumn("paper_id", F.trim(tx.text("paper_id"))).filter("paper_id <> ''")
    return d.withColumn("__n", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("__line").desc()))).filter("__n = 1").drop("__n", "__line")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, label, adjustment, note``; unknown labels are uncertain, missing adjustments follow the label."""
    d = spark.read.schema("paper_id string, label string, adjustment string, note string").csv(path, header=True, enforceSchema=False, multiLine=True, escape='"')
    label = F.lower(F.trim(tx.text("label")))
    label = F.when(label.isin("include", "exclude", "uncertain"), label).otherwise("uncertain")
    given = F.trim(tx.text("adjustment")).try_cast("double")
    own = F.when(F.col("label") == "include", 0.10).when(F.col("label") == "exclude", -0.20).otherwise(0.0)
    return _last_per_paper(d.withColumn("label", label)).select("paper_id", "label", F.coalesce(given, own).alias("adjustment"), tx.text("note").alias("note"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, label``, lower-cased, blanks dropped."""
    d = spark.read.schema("paper_id string, label string").csv(path, header=True, enforceSchema=False, multiLine=True, escape='"')
    return _last_per_paper(d.withColumn("label", F.lower(F.trim(tx.text("label")))).filter("label <> ''")).select("paper_id", "label")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """``seed_id, seed_type, title, doi, note``; a missing type follows the look of the DOI or id."""
    d = spark.read.schema("seed_id string, seed_type string, title string, doi string, note string").csv(path, header=True, enforceSchema=False, multiLine=True, escape='"')
    look = F.coalesce(F.nullif(F.trim(tx.text("doi")), F.lit("")), F.col("seed_id"))
    kind = F.when(F.trim(tx.text("seed_type")) != "", F.lower(F.trim("seed_type"))).otherwise(seed_type(look))
    return d.select("seed_id", kind.alias("seed_type"), tx.text("title").alias("title"), tx.doi_key("doi").alias("doi"), tx.text("note").alias("note"))
