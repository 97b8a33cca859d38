"""Cosine similarity of a fixed query with a text, as an expression over one row."""

from __future__ import annotations

import math
import operator
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Smooth idf over two documents: a term of only one of them.
LONE_IDF = math.log(1.5) + 1


def _count(array: Column, term: str) -> Column:
    return F.size(array) - F.size(F.array_remove(array, term))


def count_cosine(query: str, token_array: Column) -> Column:
    """Cosine of raw token counts; 0 if either side has no token. ``token_array`` must be a stored column."""
    q = Counter(tx.py_tokens(query))
    if not q:
        return F.lit(0.0)
    norm = math.sqrt(sum(v * v for v in q.values()))
    dot = sum((F.lit(float(n)) * _count(token_array, t) for t, n in sorted(q.items())), F.lit(0.0))
    return F.when(F.size(token_array) == 0, 0.0).otherwise(tx.clamp(dot / (norm * F.sqrt(square_sum(token_array)))))


def square_sum(words: Column) -> Column:
    """Sum of squared counts of a stored array: what a cosine needs of a text beside the counts of the query's terms.

    Each word in order is marked by whether the next one is the same; a run of k marks is a word that occurs k + 1 times, and adds k (k + 1) to the
    number of words. Only repeated words reach the fold.
    """
    order = F.sort_array(words)
    marks = F.array_join(F.zip_with(order, F.slice(order, F.lit(2), F.size(words)), lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    runs = F.split(marks, "0+")
    more = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * (F.length(r) + 1))
    return F.size(words) + more


def tfidf_cosine(query: str, words: Column | None, stop_words: tuple[str, ...] = (), squares: Column | None = None, counts: dict[str, Column] | None = None) -> Column:
    """TF-IDF cosine fitted on just the query and the text, in closed form.

    With smooth idf over two documents a shared term weighs 1 and any other ln(1.5) + 1. ``words`` is a stored array of the text's
    lower-cased words of two or more word characters without the stop words; the list of stop words is a parameter. ``squares`` is
    their stored square_sum() and ``counts`` their stored counts of the query's words, both of text_stats(), as a formula names each several times;
    ``words`` is not read then.
    """
    q = Counter(query_words(query, stop_words))
    if not q:
        return F.lit(0.0)
    terms = sorted(q)
    count = {t: (counts[t] if counts else _count(words, t)).cast("double") for t in terms}
    dot = sum((q[t] * count[t] for t in terms), F.lit(0.0))
    in_query = sum((F.when(count[t] > 0, float(q[t] ** 2)).otherwise(q[t] ** 2 * LONE_IDF**2) for t in terms), F.lit(0.0))
    shared_sq = sum((count[t] * count[t] for t in terms), F.lit(0.0))
    in_text = shared_sq + LONE_IDF**2 * ((square_sum(words) if squares is None else squares) - shared_sq)
    empty = F.size(words) == 0 if squares is None else squares == 0
    return F.when(empty, 0.0).otherwise(tx.clamp(dot / (F.sqrt(in_query) * F.sqrt(in_text))))


#: What words_of() takes for a word character beyond ASCII, as categories and further ranges. Letters that are newer than the engine's tables but
#: not the worker's are word characters here alone.
WORD_KINDS = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc"))
WORD_RANGES = ((0x200C, 0x200D), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))
#: Texts of ASCII and Latin letters hold no other characters that part words beyond ASCII.
LATIN = re.compile("[\\x00-\\x7f\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]*")


class Spaces(dict):
    """A table for str.translate that makes a space of each character beyond ASCII that is no word character, filled as characters come."""

    def __missing__(self, c: int) -> int:
        word = c < 128 or unicodedata.category(chr(c)) in WORD_KINDS or any(a <= c <= b for a, b in WORD_RANGES)
        self[c] = c if word else 32
        return self[c]


def words_of(lowered: Column) -> Column:
    """The runs of two or more word characters of a lower-cased text, in order, stop words included."""
    return F.regexp_extract_all(lowered, F.lit(r"(?U)\w{2,}+"), F.lit(0))


def words(c: str | Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Words for tfidf_cosine(): runs of two or more word characters, lower-cased, stop words dropped, in order."""
    # Whole runs need no word boundaries, which cost most of the search; so the stop words are dropped afterwards.
    found = words_of(F.lower(tx.text(c)))
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def query_words(query: str, stop_words: tuple[str, ...] = ()) -> list[str]:
    """The words of a driver-side query."""
    return [w for w in re.findall(r"\b\w\w+\b", query.lower()) if w not in stop_words]


STATS = "struct<squares:double,counts:array<int>>"


def word_stats(words: Column, wanted: Sequence[str], stop_words: Sequence[str] = ()) -> Column:
    """``squares``, the square_sum() of an array of words without the stop words, and ``counts``, how often each wanted word is in it, from one pass over a batch.

    The words of a batch become numbers once, and the equal (row, number) pairs are counted together; an expression would walk the array
    once for every wanted word.
    """
    listed, dropped = list(wanted), list(stop_words)

    @F.arrow_udf(STATS)
    def run(arrays: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        rows, k = len(arrays), len(listed)
        coded = arrays.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        at = pc.list_parent_indices(arrays).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, n = np.unique(at * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, number = pairs // size, pairs % size
        if dropped:
            kept = ~pc.is_in(coded.dictionary, value_set=pa.array(dropped, coded.dictionary.type)).to_numpy(zero_copy_only=False)
            kept = kept[number] if len(kept) else np.zeros(len(number), bool)
            row, number, n = row[kept], number[kept], n[kept]
        squares = np.bincount(row, weights=n.astype(np.float64) ** 2, minlength=rows)
        place = np.full(size, -1, np.int64)
        for i, w in enumerate(listed):
            found = pc.index(coded.dictionary, w).as_py()
            if found >= 0:
                place[found] = i
        counts, hit = np.zeros((rows, k), np.int32), place[number] >= 0
        counts[row[hit], place[number[hit]]] = n[hit]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), pa.array(counts.reshape(-1)))
        return pa.StructArray.from_arrays([pa.array(squares), lists], ["squares", "counts"])

    return run(words)


def text_stats(texts: Sequence[Column], groups: Sequence[Sequence[int]], wanted: Sequence[str], stop_words: Sequence[str] = ()) -> Column:
    """An array of what word_stats() gives for the words_of() lowered texts, one entry per group of them; a text may be in several groups.

    Only the texts go to the worker, which splits each once: no array of all words becomes part of a row.
    """
    listed, dropped, parts = list(wanted), list(stop_words), [list(g) for g in groups]
    # Words are bytes: all bytes of characters beyond ASCII are kept, as Spaces has taken out those that part words.
    spaced = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
    sought, stop = [w.encode() for w in listed], [w.encode() for w in dropped]

    @F.arrow_udf(f"array<{STATS}>")
    def run(rows: pa.Array) -> pa.Array:
        table = Spaces()
        columns = [rows.field(i).to_pylist() for i in range(rows.type.num_fields)]
        squares, counts = [], []
        for row in zip(*columns, strict=True):
            split = [Counter((t if t.isascii() or LATIN.fullmatch(t) else t.translate(table)).encode().translate(spaced).split()) for t in (t or "" for t in row)]
            for group in parts:
                first, *others = sorted((split[i] for i in group), key=len, reverse=True)
                n = Counter(first)
                for other in others:
                    n.update(other)
                for w in [w for w in n if len(w) < 5 and len(w.decode()) == 1] + [w for w in stop if w in n]:
                    del n[w]
                squares.append(float(sum(map(operator.mul, n.values(), n.values()))))
                counts.extend([n.get(w, 0) for w in sought])
        k, size = len(parts), len(squares)
        told = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * len(listed)), pa.array(counts, pa.int32()))
        flat = pa.StructArray.from_arrays([pa.array(squares, pa.float64()), told], ["squares", "counts"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), flat)

    return run(F.struct(*[F.make_valid_utf8(t).alias(f"t{i}") for i, t in enumerate(texts)]))


class Stats:
    """The square sums and counts in a column of text_stats(), by the number of the group."""

    def __init__(self, name: str, wanted: Sequence[str]) -> None:
        self.name, self.wanted = name, list(wanted)

    def of(self, group: int) -> tuple[Column, dict[str, Column]]:
        """What tfidf_cosine() takes as ``squares`` and ``counts``."""
        own = F.get(F.col(self.name), F.lit(group))
        return own["squares"], {w: F.get(own["counts"], F.lit(i)) for i, w in enumerate(self.wanted)}


def wanted_words(queries: Sequence[str], stop_words: Sequence[str] = ()) -> list[str]:
    """All words of the queries, once each."""
    return sorted({w for q in queries for w in query_words(q, tuple(stop_words))})
