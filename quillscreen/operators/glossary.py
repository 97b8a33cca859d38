"""Terms of a glossary in texts, and the English seeds of a question in another language.

The glossary is searched with one automaton (``functions.matcher``), so a text is read once whatever its size. Longer entries win over those
inside them; results keep no term twice. Nulls count as empty texts, which have no terms.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import matcher
from quillscreen.functions import text as tx

#: How many terms a translation and a query seed hold, and the seed of a question without any term.
MOST_TERMS, MOST_SEEDS, NO_SEED = 32, 10, "scientific research topic"
#: Runs of Latin text inside a question.
LATIN = r"[A-Za-z][A-Za-z0-9+\-_/ ]*"


def targets(value: str) -> list[str]:
    """The terms of a glossary entry, which semicolons or bars separate."""
    return [" ".join(p.split()) for p in re.split("[;|]", value) if p.strip()]


def _unique(terms: Column, most: int) -> Column:
    """First of the terms that agree without case, at most so many."""
    first = F.filter(terms, lambda t, i: F.array_position(F.transform(terms, F.lower), F.lower(t)) == i + 1)
    return F.slice(first, 1, most)


def _lookup(numbers: Column, values: Sequence[Sequence[str]]) -> Column:
    """The terms of each number, in order."""
    none = F.array().cast("array<string>")
    table = F.array(*[F.array(*[F.lit(t) for t in v]) if v else none for v in values])
    return F.flatten(F.transform(numbers, lambda n: F.get(table, n))) if values else none


def glossary_terms(d: DataFrame, text: str | Column, translations: Mapping[str, str], expansions: Mapping[str, str] | None = None, to: str = "terms") -> DataFrame:
    """``d`` with the English terms of a text: the translations of its entries, longest first, then the expansions of the phrases it holds, in their order."""
    expansions = dict(expansions or {})
    words, phrases = [w for w in translations if w.strip()], [p for p in expansions if p.strip()]
    d = d.withColumns({"__t": matcher.longest_first(tx.text(text), words), "__e": matcher.first_hits(tx.text(text), phrases)})
    terms = F.concat(_lookup(F.col("__t.term"), [targets(translations[w]) for w in words]), _lookup(F.col("__e.term"), [targets(expansions[p]) for p in phrases]))
    return d.withColumn("__all", terms).withColumn(to, _unique(F.col("__all"), MOST_TERMS)).drop("__t", "__e", "__all")


def query_seed(d: DataFrame, question: str | Column, glossary: Sequence[tuple[str, str]], to: str = "seed") -> DataFrame:
    """``d`` with an English query for a question: the translations of the entries it holds, in the glossary's order, then its own Latin phrases.

    A term whose tokens all occurred before adds nothing.
    """
    d = d.withColumn("__q", tx.collapsed(question)).withColumn("__h", matcher.first_hits(F.col("__q"), [w for w, _ in glossary]))
    phrases = F.filter(F.transform(F.regexp_extract_all("__q", F.lit(LATIN), F.lit(0)), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    d = d.withColumn("__all", F.concat(_lookup(F.col("__h.term"), [[e.lower()] for _, e in glossary]), phrases))

    def append(so_far: Column, term: Column) -> Column:
        have, own = tx.tokens(F.array_join(so_far, " ")), F.array_distinct(tx.tokens(term))
        known = F.array_contains(so_far, term) | ((F.size(own) > 0) & (F.size(F.array_except(own, have)) == 0))
        return F.when(known, so_far).otherwise(F.concat(so_far, F.array(term)))

    kept = F.slice(F.aggregate("__all", F.array().cast("array<string>"), append), 1, MOST_SEEDS)
    return d.withColumn(to, F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), F.lit(NO_SEED))).drop("__q", "__h", "__all")
