"""Many terms searched in one pass over each text: an automaton of all terms, built once per worker.

A plan with one ``contains`` per term reads a text once for every term and grows with their number; the automaton reads it once, and its plan is
one Arrow function whatever the number of terms. Only hits leave the worker. Positions count characters, ends are exclusive.

Defined cases: a null or empty text has no hits; blank terms are never found; of equal terms the first one stands for all in ``longest``, and
each is found in ``hits``; an empty list of terms finds nothing.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillscreen.functions import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HITS = "array<struct<term:int,start:int>>"
STANDING = "struct<found:array<int>,clear:array<int>,words:array<int>>"
#: What makes a neighbour part of the same token.
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: Needles up to which each is looked for on its own, by the string search of the language; it stops at the first hit that tells all.
FEW = 64
#: What tx.domain_text() does, for a string in a worker.
_ENTITIES = tuple(tx.ENTITIES.items())
_REWRITES = tuple((re.compile(pattern, re.ASCII), to.replace("$", "\\"), tuple(needs)) for (pattern, to), needs in zip(tx.REWRITES, tx.NEEDS, strict=True))
#: Automata of this process by their terms; a worker meets few lists.
_built: dict[tuple[str, ...], ahocorasick.Automaton | None] = {}


def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """The automaton of the terms, whose values are the numbers of equal terms; None if there is nothing to find."""
    if terms not in _built:
        places: dict[str, list[int]] = {}
        for i, t in enumerate(terms):
            if t.strip():
                places.setdefault(t, []).append(i)
        made = ahocorasick.Automaton() if places else None
        for t, numbers in places.items():
            made.add_word(t, (len(t), tuple(numbers)))
        if made:
            made.make_automaton()
        _built[terms] = made
    return _built[terms]


def occurrences(text: str, terms: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """(number of the term, start) of every occurrence, overlapping ones included, by end."""
    found = automaton(terms)
    for end, (size, numbers) in found.iter(text) if found and text else ():
        for n in numbers:
            yield n, end - size + 1


def leftmost_longest(text: str, terms: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """(number of the term, start) of occurrences that do not overlap: the leftmost first, of those the longest."""
    free = 0
    for start, _, n in sorted((start, -len(terms[n]), n) for n, start in occurrences(text, terms)):
        if start >= free:
            free = start + len(terms[n])
            yield n, start


def comparable(value: str) -> str:
    """tx.domain_text() of a string, where looking for what a rewrite needs costs next to nothing. Classes and case are those of the engine's patterns,
    which know ASCII alone."""
    if "&" in value:
        for name, char in _ENTITIES:
            value = value.replace(name, char)
    for pattern, to, needs in _REWRITES:
        if any(n in value for n in needs):
            value = pattern.sub(to, value)
    return value.lower()


def _listed(per_text: Callable[[str], list[tuple[int, int]]], returns: str):
    @F.arrow_udf(returns)
    def run(texts: pa.Array) -> pa.Array:
        sizes, terms, starts = [0], [], []
        for t in texts:
            for n, start in per_text(t.as_py() or ""):
                terms.append(n)
                starts.append(start)
            sizes.append(len(terms))
        flat = pa.StructArray.from_arrays([pa.array(terms, pa.int32()), pa.array(starts, pa.int32())], ["term", "start"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)

    return run


def hits(text: Column, terms: Sequence[str]) -> Column:
    """All occurrences of the terms in a text, in order of start and then of term."""
    listed = tuple(terms)
    return _listed(lambda t: sorted(occurrences(t, listed), key=lambda h: (h[1], h[0])), HITS)(text)


def first_hits(text: Column, terms: Sequence[str]) -> Column:
    """The first occurrence of each term that a text holds, in the order of the terms."""
    listed = tuple(terms)

    def first(t: str) -> list[tuple[int, int]]:
        met: dict[int, int] = {}
        for n, start in occurrences(t, listed):
            met.setdefault(n, start)
        return sorted(met.items())

    return _listed(first, HITS)(text)


def longest(text: Column, terms: Sequence[str]) -> Column:
    """Leftmost-longest occurrences that do not overlap."""
    listed = tuple(terms)
    return _listed(lambda t: list(leftmost_longest(t, listed)), HITS)(text)


def uncovered(text: str, terms: tuple[str, ...]) -> list[tuple[int, int]]:
    """The first occurrence of each term that does not lie within that of a longer term chosen before it.

    Terms are tried by falling length, equal ones in their order; of a term that overlaps itself the leftmost occurrences count.
    """
    places: dict[int, list[int]] = {}
    for n, start in occurrences(text, terms):
        places.setdefault(n, []).append(start)
    taken: list[tuple[int, int]] = []
    chosen: list[tuple[int, int]] = []
    for n in sorted(places, key=lambda n: (-len(terms[n]), n)):
        free, size = 0, len(terms[n])
        for start in places[n]:
            if start < free:
                continue
            free = start + size
            if not any(a <= start and free <= b for a, b in taken):
                taken.append((start, free))
                chosen.append((n, start))
                break
    return chosen


def longest_first(text: Column, terms: Sequence[str]) -> Column:
    """``uncovered`` of each text, the longest terms first."""
    listed = tuple(terms)
    return _listed(lambda t: uncovered(t, listed), HITS)(text)


PRESENT = "struct<found:array<int>,words:array<int>>"


def present(text: Column, needles: Sequence[str]) -> Column:
    """``found``: the needles that occur; ``words``: those that occur between characters that are no lower-case ASCII letters or digits, as tokens do.

    A needle is left at its first occurrence of the second kind, so a text is seldom read to its end, and the plan carries no array of tokens.
    """
    listed = tuple(needles)

    @F.arrow_udf(PRESENT)
    def run(texts: pa.Array) -> pa.Array:
        parts: list[list[list[int]]] = [[], []]
        for t in texts:
            t, found, words = t.as_py() or "", [], []
            for n in [n for n, needle in enumerate(listed) if needle] if len(listed) <= FEW else sorted({n for n, _ in occurrences(t, listed)}):
                needle = listed[n]
                start = t.find(needle)
                if start >= 0:
                    found.append(n)
                while start >= 0:
                    end = start + len(needle)
                    if t[start - 1 : start] not in ALNUM and t[end : end + 1] not in ALNUM:
                        words.append(n)
                        break
                    start = t.find(needle, start + 1)
            parts[0].append(found)
            parts[1].append(words)
        return pa.StructArray.from_arrays([pa.array(p, pa.list_(pa.int32())) for p in parts], ["found", "words"])

    return run(text)


class Present:
    """Needles of one text column: the tests name them, and ``column`` looks for all of them at once."""

    def __init__(self, name: str) -> None:
        self.name, self.numbers = name, {}

    def _in(self, part: str, needle: str) -> Column:
        return F.array_contains(F.col(f"{self.name}.{part}"), self.numbers.setdefault(needle, len(self.numbers)))

    def has_tokens(self, term: str) -> Column:
        """tx.has_tokens() of the column's tokens."""
        found = F.lit(bool(tx.py_tokens(term)))
        for w in sorted(set(tx.py_tokens(term))):
            found = found & self._in("words", w)
        return found

    def has_term(self, term: str) -> Column:
        """tx.has_term() of the column and its tokens."""
        cleaned = " ".join(term.lower().split())
        return F.lit(False) if not cleaned else self._in("found", cleaned) | self.has_tokens(cleaned)

    def column(self, lowered: Column) -> Column:
        """The hits, once all needles are known."""
        return present(lowered, list(self.numbers))


def standing(text: Column, needles: Sequence[str], raw: bool = False) -> Column:
    """``found``: the needles that occur; ``clear``: those with an occurrence that no word before or after it negates; ``words``: those that
    occur between characters that are no lower-case ASCII letters or digits, as tokens do.

    The words of negation are looked for around hits only, and a needle is left as soon as all three are known of it. Beyond ``FEW`` needles the
    automaton tells which ones a text holds. A ``raw`` text is made comparable first, as tx.domain_text() does.
    """
    listed = tuple(needles)
    before, after, room, rest = tx.NEGATED_BEFORE, tx.NEGATED_AFTER, tx.BEFORE_CHARS, tx.AFTER_CHARS
    sought = [n for n, needle in enumerate(listed) if needle.strip()]

    def negated(t: str, start: int, end: int) -> bool:
        left, right = t[max(0, start - room) : start], t[end : end + rest]
        return any(m in left for m in before) or any(m in right for m in after)

    @F.arrow_udf(STANDING)
    def run(texts: pa.Array) -> pa.Array:
        parts: list[list[list[int]]] = [[], [], []]
        for t in texts:
            t, found, clear, words = t.as_py() or "", [], [], []
            if raw:
                t = comparable(t)
            for n in sought if len(sought) <= FEW else sorted({n for n, _ in occurrences(t, listed)}):
                needle = listed[n]
                start = t.find(needle)
                if start < 0:
                    continue
                found.append(n)
                stands = whole = False
                while start >= 0 and not (stands and whole):
                    end = start + len(needle)
                    stands = stands or not negated(t, start, end)
                    whole = whole or (t[start - 1 : start] not in ALNUM and t[end : end + 1] not in ALNUM)
                    start = t.find(needle, start + 1)
                if stands:
                    clear.append(n)
                if whole:
                    words.append(n)
            for part, numbers in zip(parts, (found, clear, words), strict=True):
                part.append(numbers)
        return pa.StructArray.from_arrays([pa.array(p, pa.list_(pa.int32())) for p in parts], ["found", "clear", "words"])

    return run(text)


#: Spellings of a concept, and what stands for them where none occurs: words with the forms of which one must stand as a token; empty for spellings alone.
Concept = tuple[tuple[str, ...], tuple[tuple[str, tuple[str, ...]], ...]]


def held(text: Column, concepts: Sequence[Concept]) -> Column:
    """The numbers of the concepts that a text holds, once it is made comparable as tx.domain_text() does.

    A spelling that stands without a negation around it holds; where no spelling occurs at all, every word must have a form that stands as a token, and must
    itself stand without negation if it occurs. Each needle is looked for once in a text, only when a concept comes to it, and no further than its first
    telling occurrence, so common words are not listed and most spellings of an absent concept are settled by the letters they begin with.
    """
    before, after, room, rest = tx.NEGATED_BEFORE, tx.NEGATED_AFTER, tx.BEFORE_CHARS, tx.AFTER_CHARS
    listed = [(os.path.commonprefix(spelled) if len(spelled) > 1 else "", spelled, loose) for spelled, loose in concepts]

    def clear(t: str, needle: str, start: int) -> bool:
        while start >= 0:
            end = start + len(needle)
            left, right = t[max(0, start - room) : start], t[end : end + rest]
            if not (any(m in left for m in before) or any(m in right for m in after)):
                return True
            start = t.find(needle, start + 1)
        return False

    def whole(t: str, needle: str, start: int) -> bool:
        while start >= 0:
            end = start + len(needle)
            if t[start - 1 : start] not in ALNUM and t[end : end + 1] not in ALNUM:
                return True
            start = t.find(needle, start + 1)
        return False

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        sizes, numbers = [0], []
        for t in texts:
            t = comparable(t.as_py() or "")
            # Where each needle first stands, and whether it does so clear of negation or as a token, as far as anything asked.
            places: dict[str, int] = {}
            known: dict[tuple[str, Callable], bool] = {}

            def place(needle: str) -> int:
                if needle not in places:
                    places[needle] = t.find(needle)
                return places[needle]

            def asked(test: Callable, needle: str) -> bool:
                if (needle, test) not in known:
                    known[needle, test] = place(needle) >= 0 and test(t, needle, place(needle))
                return known[needle, test]

            for i, (start, spelled, loose) in enumerate(listed):
                found = [n for n in spelled if place(n) >= 0] if not start.strip() or place(start) >= 0 else []
                if any(asked(clear, n) for n in found) if found else loose and all(any(asked(whole, f) for f in forms) and (place(w) < 0 or asked(clear, w)) for w, forms in loose):
                    numbers.append(i)
            sizes.append(len(numbers))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(numbers, pa.int32()))

    return run(text)
