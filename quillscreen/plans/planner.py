"""Driver-side planning of one question: seed hints, the domain it belongs to, and query texts for each provider.

Knowledge of domains comes in as packs; none is built in. The results are small tables and contracts for the data plane.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillscreen.functions.text import unique
from quillscreen.plans.contract import Contract

FALLBACK = "general_science"
QUOTED = re.compile("[\"“”‘']([^\"“”]{8,}?)[\"“”’']")
DOI = re.compile(r"\b10\.[0-9]{4,9}/[^\s\"<>]+", re.I)
ARXIV = re.compile(r"\barxiv[:\s]*([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+/[0-9]{7})", re.I)
COLON = re.compile(r"([A-Z][\w'’-]+(?:\s+[\w'’-]+){2,})\s*:\s*([A-Za-z0-9'’ ,-]+)")
EDGES = " \t\r\n.,;\"'“”‘’，。)"
#: Query texts a plan keeps for each provider.
LIMITS = {"openalex": 6, "semantic_scholar": 14}


@dataclass(frozen=True)
class SeedHint:
    kind: str
    value: str
    confidence: float


@dataclass(frozen=True)
class Pack:
    """A domain's cue groups. It is active once ``least`` of the positive groups occur and no negative cue does."""

    name: str
    positive: tuple[tuple[str, ...], ...]
    negative: tuple[tuple[str, ...], ...] = ()
    least: int = 1
    extra: dict = field(default_factory=dict)


def _titled(value: str) -> bool:
    """Five words or more, of which three start in upper case."""
    words = re.findall(r"[A-Za-z][\w'’-]*", value)
    return len(words) >= 5 and sum(w[0].isupper() for w in words) >= 3


def seed_hints(question: str) -> list[SeedHint]:
    """Titles in quotes or with a colon, DOIs and arXiv ids that a question names, each once."""
    text = " ".join((question or "").split())
    found = [SeedHint("title", t, 0.86) for m in QUOTED.finditer(text) if _titled(t := m[1].strip(EDGES))]
    for m in COLON.finditer(text):
        t = re.sub(r"\s+(?:and|or|with|for|of|to|in|as)$", "", f"{m[1]}: {m[2].strip(EDGES)}").rstrip(" ,;:")
        found += [SeedHint("title", t, 0.80)] if _titled(t) else []
    found += [SeedHint("doi", m[0].strip(EDGES), 0.98) for m in DOI.finditer(text)]
    found += [SeedHint("arxiv", m[1].strip(EDGES), 0.96) for m in ARXIV.finditer(text)]
    once: dict[tuple[str, str], SeedHint] = {}
    for h in found:
        once.setdefault((h.kind, re.sub(r"\W+", " ", h.value.lower()).strip()), h)
    return list(once.values())


def load_packs(spark: SparkSession, path: str) -> list[Pack]:
    """Packs from JSON files with name, positive_groups, negative_groups and min_positive_groups."""
    rows = spark.read.text(path, wholetext=True).collect()
    made = [json.loads(r.value) for r in rows]
    groups = lambda x: tuple(tuple(g) for g in x or ())
    return [Pack(p.get("name") or p["domain_name"], groups(p.get("positive_groups")), groups(p.get("negative_groups")), int(p.get("min_positive_groups") or 1), p) for p in made]


def route(question: str, packs: list[Pack], hint: str = "") -> tuple[str, float]:
    """Domain and confidence: the share of positive groups that occur decides among active packs, ties by name."""
    text, best = " ".join((question or "").lower().split()), []
    occurs = lambda group: any(" ".join(t.lower().split()) in text for t in group if t.strip())
    for p in packs:
        n = sum(map(occurs, p.positive))
        if n < p.least or any(map(occurs, p.negative)):
            continue
        score = max(n / max(1, len(p.positive)), 1.0 if p.name == hint else 0.0)
        best.append((-score, p.name))
    if not best:
        return FALLBACK, 0.35 if text else 0.0
    score, name = min(best)
    return name, round(min(0.95, 0.35 - score * 0.6), 4)


def _phrase(term: str) -> str:
    return f'"{term}"' if " " in term else term


def provider_queries(contract: Contract, provider: str) -> list[str]:
    """Query texts: one joins all required groups, each group by its first terms, and one is made per optional group beside it."""
    joiner, either = (" AND ", " OR ") if provider == "openalex" else (" + ", " | ")
    group = lambda terms: "(" + either.join(_phrase(t) for t in terms[:4]) + ")"
    core = joiner.join(group(g.terms) for g in contract.groups if g.required and g.terms)
    texts = [core] + [joiner.join(filter(None, [core, group(g.terms)])) for g in contract.groups if not g.required and g.terms]
    return unique([t for t in texts if t] or [contract.question], LIMITS.get(provider, 6))


def planned_queries(spark: SparkSession, contracts: list[Contract], providers: tuple[str, ...] = ("openalex", "semantic_scholar")) -> DataFrame:
    """The planned queries of many questions as one small table for the scans and the provenance joins."""
    rows = [(c.question_id, p, q, "contract", n) for c in contracts for p in providers for n, q in enumerate(provider_queries(c, p))]
    return spark.createDataFrame(rows, "question_id string, provider string, query string, source string, ord int")
