"""Screening again after an expansion: only papers whose content was never assessed under this contract are assessed.

What the plan says about a paper on its own depends on the paper's content and the contract. It is stored under a digest of the content, in a folder named by a digest of the
contract, the year and the rules, so another contract never meets these rows. A run looks the digests of its papers up, assesses the
distinct ones that are missing, adds them, and reads everything back; what depends on the other papers (shares of roles, ranks, venue
diversity, decisions) is computed over the union each time. The result equals a full run.

Defined cases: papers of equal content share one assessment, whatever their ids; nulls are part of the content, and a null is not an empty
text; an empty table gives no rows; ``paper_id``, ``question_id`` and ``input_ord`` are no content, all other columns are. A run that fails while
it adds rows leaves nothing that changes a later one, as repeated digests are read once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.operators import dedup, ranking, roles
from quillscreen.operators.store import checkpointed, join_aggregate, small
from quillscreen.plans import screening
from quillscreen.plans.contract import Contract

NOT_CONTENT = ("paper_id", "question_id", "input_ord")


def version(contract: Contract, now_year: int, role_rules) -> str:
    """Names the assessments that one contract, year and set of rules lead to."""
    return hashlib.sha256(repr((contract, now_year, role_rules)).encode()).hexdigest()[:32]


def content_digest(papers: DataFrame):
    """SHA-256 over all columns of the content, by name."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(papers.columns) if c not in NOT_CONTENT]), {"ignoreNullFields": "false"}), 256)


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The assessments stored so far; None before the first run."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return spark.read.parquet(folder) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def assess_missing(papers: DataFrame, contract: Contract, now_year: int, folder: str, role_rules=roles.GENERIC_RULES) -> tuple[DataFrame, int]:
    """``papers`` with their assessments, and how many distinct contents had to be assessed for them."""
    spark = papers.sparkSession
    folder = f"{folder.rstrip('/')}/{version(contract, now_year, role_rules)}"
    keyed = papers.withColumn("__digest", content_digest(papers))
    known = stored(spark, folder)
    digests = keyed.select("__digest").distinct()
    if known is not None:
        digests = digests.join(known.select("__digest").distinct(), "__digest", "left_anti")
    digests = checkpointed(digests)
    n = digests.count()
    if n:
        # One row stands for each content; which one does not matter, as they only differ in what is no content.
        first = keyed.join(small(digests), "__digest", "left_semi").dropDuplicates(["__digest"])
        made = screening.assess(screening.classified(first, role_rules), contract, now_year)
        own = [c for c in made.columns if c not in papers.columns]
        made.select(*own).write.mode("append").parquet(folder)
    known = stored(spark, folder)
    if known is None:  # no papers at all: the plan alone tells the columns
        made = screening.assess(screening.classified(keyed, role_rules), contract, now_year)
        return made.drop("__digest"), 0
    return join_aggregate(keyed, known.dropDuplicates(["__digest"]), ["__digest"]).drop("__digest"), n


def screen_again(papers: DataFrame, contract: Contract, now_year: int, folder: str, profile: str = "balanced", role_rules=roles.GENERIC_RULES) -> tuple[DataFrame, int]:
    """The decisions of ``screening.screen_and_decide`` over the papers, and how many contents were assessed for them."""
    d, n = assess_missing(papers, contract, now_year, folder, role_rules)
    return screening.decide_stored(ranking.stored(d), contract, profile), n


def expand(merged: DataFrame, found: DataFrame, contract: Contract, now_year: int, folder: str, profile: str = "balanced", role_rules=roles.GENERIC_RULES) -> tuple[DataFrame, int]:
    """A run after an expansion: the papers found join those there are, duplicates merge, and the union is screened again."""
    union = found.unionByName(merged, allowMissingColumns=True)
    return screen_again(dedup.deduplicate(union), contract, now_year, folder, profile, role_rules)
