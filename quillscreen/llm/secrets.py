"""Secret scans with corpus-wide ownership frequency.

Base detectors find assignments, access keys and hex runs. A high-recall detector then proposes long mixed tokens. Every
candidate value is hashed and its distinct repositories and owners are counted over the whole corpus: values held by more than
``max_owners`` owners or ``max_repos`` repositories are widely copied examples, the rest are owner-specific and look live.
Live mixed tokens become spans of kind ``token``; base spans always stay, and are told apart in ``n_live`` and ``n_example``.

Offsets are code points, end exclusive. Defined cases: a null text is empty; rows without an owner share one; repeated rows
count as rows of the same repository and each get their row; rows that share an id but not the text are told apart; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm.common import cut, documents, join_aggregate

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Kinds in the order that breaks ties; the last is the method's own.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run of too few characters fails as a whole, so the least length can stand in the pattern for these two.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs of token characters; mixed() keeps those with digits and both cases.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ROW = "doc_id {}, owner string, repo string, text_hash string, n_assign long, n_access long, n_hex long, base string, base_sha256 string, found array<struct<kind:string,start:long,end:long,value:string>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret value) of the base detectors, ordered by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def mixed(value: str) -> bool:
    """Digits, upper and lower case together, at least four of the first: what random keys have and prose has not."""
    return sum(c.isdigit() for c in value) >= 4 and any(c.isupper() for c in value) and any(c.islower() for c in value)


def proposed(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Mixed tokens that no base span overlaps; both sides run from left to right, so one pass is enough."""
    found, i, reach = [], 0, 0
    for m in RUN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start() and mixed(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """A compact row per document with its base figures and all candidates; values are kept as SHA-256 only."""
    kind = docs.schema[id_col].dataType.simpleString()

    def one(text: str | None) -> tuple:
        text = text or ""
        base = base_spans(text)
        every = sorted(base + proposed(text, base))
        found = [{"kind": KINDS[k], "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()} for s, k, e, v in every]
        line = joined(base)
        n = [sum(x[1] == k for x in base) for k in range(3)]
        return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest(), *n, line, hashlib.sha256(line.encode()).hexdigest(), found

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["text_hash", "n_assign", "n_access", "n_hex", "base", "base_sha256", "found"]
        for part in it:
            got = pd.DataFrame([one(t) for t in part["t"]], columns=names, index=part.index)
            yield pd.concat([part[["doc_id", "owner", "repo"]], got], axis=1)

    repo = F.col(repo_col or id_col).cast("string").alias("repo")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), repo, F.col(text_col).alias("t")).mapInPandas(run, ROW.format(kind))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 2, max_repos: int = 20) -> DataFrame:
    """One row per document: base figures, all ``spans``, and how many of the spans look live or are widely copied.

    ``repo_col`` names the repository; unset, every document is a repository of its own, told by its id.
    """
    rows = cut(scan(docs, id_col, text_col, owner_col, repo_col))
    each = rows.filter(F.size("found") > 0).select("doc_id", "owner", "repo", "text_hash", F.explode("found").alias("x"))
    held = each.select(F.col("x.value").alias("value"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    per_owner = held.groupBy("value", "owner").agg(F.count("*").alias("n"))
    own = per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"))
    own = own.select("value", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("live"))
    told = join_aggregate(each.drop("repo").distinct().withColumn("value", F.col("x.value")), own, ["value"])
    span = F.struct(F.col("x.start").alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("x.kind")).alias("k"), F.concat_ws(":", "x.kind", "x.start", "x.end").alias("s"))
    shown = (F.col("x.kind") != "token") | F.col("live")
    per_doc = told.groupBy("doc_id", "owner", "text_hash").agg(
        F.sort_array(F.collect_list(F.when(shown, span))).alias("all"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_example"),
    )
    per_doc = per_doc.select(*[F.col(c).alias(f"r_{c}") for c in ("doc_id", "owner", "text_hash")], F.array_join(F.transform("all", lambda s: s["s"]), ",").alias("all"), "n_live", "n_example")
    same = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & F.col("owner").eqNullSafe(F.col("r_owner")) & (F.col("text_hash") == F.col("r_text_hash"))
    return rows.join(per_doc, same, "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("all", "base").alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; the owner is ``source`` and every document is a repository."""
    return scan_secrets(documents(spark, sf_dir))
