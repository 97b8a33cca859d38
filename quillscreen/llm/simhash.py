"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Fingerprints that differ in at most four bits share at least four bytes at equal positions, so
a pair is a candidate exactly if its tally of shared positional bytes reaches four. Posting lists of single bytes hold a
share of the corpus that never shrinks, so tallying them pair by pair would grow with the square of the corpus. Postings are
therefore combined: each fingerprint is listed under its 70 sets of four (position, byte) entries, and two fingerprints meet
in a list if and only if their tally is four or more. The tally and then the Hamming distance verify each pair that meets.

Only connectivity is needed, so a list with many members is never expanded into its pairs. Every member is first compared
with the smallest one of its list; after the components of those links are known, only members outside the component of
that smallest one are compared with the rest of the list. A pair that is skipped is connected already, so no link between
components is lost. With at most ``LIST`` members outside, that is at most ``LIST`` comparisons a member. A list with more of them is searched by the same counting
once more: two members that differ in at most four bits share at least four of the eight half-bytes outside the list's bytes, so the list is
split under its 70 sets of four half-bytes, and a sublist holds at most 2^16 fingerprints however many the list has.

Defined cases: a null or blank text has fingerprint zero, which links like any other; fewer than four words are one shingle;
repeated rows and equal ids each get a row; a null id never becomes a component id unless no member has an id; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm.common import cut, discard, documents, join_aggregate, small
from quillscreen.llm.graph import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS, SEED, BYTES = 4, 42, 8
#: Members outside the component of a list's smallest one beyond which the comparison with the rest of the list goes by sublists.
LIST = 64
#: Members of a list that one task compares; those outside meet each such part of it.
PART = 4096
#: Hashes whose bits are unpacked at once.
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as an unsigned integer: a bit is set if it is set in over half of the shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h64, n = xxhash.xxh64_intdigest, len(words) - SHINGLE_WORDS + 1
    shingles = (b" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, n)))
    ones, total = np.zeros(64, np.int64), max(1, n)
    while len(h := np.fromiter((h64(s, SEED) for s in itertools.islice(shingles, CHUNK)), np.uint64)):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            fp = np.array([fingerprint(t) for t in part["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "fp": fp})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def postings(fps: DataFrame, least: int) -> DataFrame:
    """``key, fp``: a row for every set of ``least`` byte positions; the key holds the set's number and its bytes."""
    keys = []
    for k, at in enumerate(itertools.combinations(range(BYTES), least)):
        key = F.lit(k).cast("long")
        for i in at:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), i))
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def sublists(table: DataFrame, least: int) -> DataFrame:
    """``table`` with a column ``sub``: the member's part of the list where at most LIST members are ``outside``, else one row per set of half-bytes
    outside the list's bytes.

    A list of ``least`` equal bytes leaves 8 - least of them, that is twice as many half-bytes; as ``8 - least`` bits at most may differ,
    as many half-bytes at least agree.
    """
    rest = BYTES - least
    outside = F.lit([[i for i in range(BYTES) if i not in at] for at in itertools.combinations(range(BYTES), least)])
    picks = F.lit([list(p) for p in itertools.combinations(range(2 * rest), rest)])
    number = F.shiftright("key", 8 * least).cast("int")
    sets = F.when(F.col("outside") > LIST, F.sequence(F.lit(1), F.size(picks))).otherwise(F.array(F.lit(0)))
    # One row per set before its key is made, so that the key is one small expression and not seventy.
    rows = table.withColumn("__set", F.explode(sets))
    half = lambda i: F.call_function("shiftrightunsigned", F.col("fp"), F.get(F.get(outside, number), F.floor(i / 2).cast("int")) * 8 + F.pmod(i, F.lit(2)) * 4).bitwiseAND(F.lit(15))
    key = F.aggregate(F.get(picks, F.col("__set") - 1), F.col("__set").cast("long"), lambda acc, i: F.shiftleft(acc, 4).bitwiseOR(half(i)))
    return rows.withColumn("sub", F.when(F.col("__set") > 0, key).otherwise(F.pmod(F.xxhash64("fp"), parts(F.col("n"))))).drop("__set")


def parts(n: Column) -> Column:
    """The number of parts of a list of n members."""
    return F.ceil(n / PART).cast("long")


def near(a: Column, b: Column, max_bits: int, least: int) -> Column:
    """The tally of shared positional bytes reaches ``least`` and at most ``max_bits`` bits differ."""
    shared = sum((F.when(_byte(a, i) == _byte(b, i), 1).otherwise(0) for i in range(BYTES)), F.lit(0))
    return (shared >= least) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)


def link_classes(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``fp, label`` for every distinct fingerprint with a link; ``max_bits`` may be 1 to 4 (sets of four to seven bytes)."""
    least = BYTES - max_bits
    # A fingerprint becomes 70 rows, so the few bytes of the input are dealt over all cores first.
    fps = cut(fps.select("fp").distinct())
    dealt = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = postings(dealt, least).groupBy("key").agg(F.min("fp").alias("first"), F.count("*").alias("n")).filter("n > 1")
    lists = cut(lists.select(F.col("key").alias("list"), "first", "n"))
    member = cut(postings(dealt, least).join(small(lists), F.col("key") == F.col("list")).select("key", "first", "n", "fp"))
    discard(lists)
    links = member.filter("fp <> first").filter(near(F.col("first"), F.col("fp"), max_bits, least)).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    label = cut(components(links))
    of = lambda name, to: label.select(F.col("node").alias(name), F.col("label").alias(to))
    told = member.join(of("n1", "own"), F.col("fp") == F.col("n1"), "left").join(of("n2", "head"), F.col("first") == F.col("n2"), "left")
    told = cut(told.select("key", "n", "fp", F.coalesce("own", "fp").alias("own"), F.coalesce("head", "first").alias("head")))
    discard(member)
    # Only lists with a member outside the head's component have anything left to compare.
    open_ = cut(told.filter("own <> head").groupBy("key").agg(F.count("*").alias("outside")))
    told = sublists(told.join(small(open_), "key"), least)
    meets = F.when(F.col("outside") > LIST, F.array("sub")).otherwise(F.sequence(F.lit(0).cast("long"), parts(F.col("n")) - 1))
    out = told.filter("own <> head").select(F.col("key").alias("k"), F.explode(meets).alias("s"), F.col("fp").alias("x"), F.col("own").alias("x_own"))
    met = (F.col("k") == F.col("key")) & (F.col("s") == F.col("sub"))
    late = out.join(told, met & (F.col("own") != F.col("x_own")) & near(F.col("x"), F.col("fp"), max_bits, least))
    late = late.select(F.col("x_own").alias("a"), F.col("own").alias("b")).distinct()
    return components(label.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(late)).select(F.col("node").alias("fp"), "label")


def classes(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``print, label`` for every distinct fingerprint: fingerprints of one component share a label."""
    label = link_classes(fps, max_bits).select(F.col("fp").alias("linked"), "label")
    return cut(fps.select("fp").distinct().join(label, F.col("fp") == F.col("linked"), "left").select(F.col("fp").alias("print"), F.coalesce("label", "fp").alias("label")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links."""
    fps = cut(fingerprints(docs, id_col, text_col))
    cls = classes(fps, max_bits)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = first.join(cls, F.col("fp") == F.col("print")).groupBy("label").agg(F.min("least").alias("component_id"))
    cls = join_aggregate(cls, comp, ["label"]).select(F.col("print").alias("fp"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_aggregate(fps, cls, ["fp"]).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, then the smallest text hash, null ids last.

    Rows that agree in id and text are one row. Texts are not shuffled while the keys of the kept rows can be broadcast.
    """
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), h.alias("h")).alias("key"), F.col(text_col).alias("text"))
    fps = cut(fingerprints(keyed, "key", "text"))
    cls = classes(fps, max_bits)
    each = fps.groupBy("fp").agg(F.min("doc_id").alias("key")).join(cls, F.col("fp") == F.col("print"))
    kept = each.groupBy("label").agg(F.min("key").alias("key")).select(F.col("key.id").alias("__kept_id"), F.col("key.h").alias("__kept_hash"))
    twice = fps.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id.id").alias("__twice_id"), F.col("doc_id.h").alias("__twice_hash"))
    at = lambda name: F.col(id_col).eqNullSafe(F.col(f"__{name}_id")) & (h == F.col(f"__{name}_hash"))
    rows = docs.join(small(cut(kept)), at("kept"), "left_semi")
    twice = cut(twice)
    once = rows.join(small(twice), at("twice"), "left_anti")
    return once.union(rows.join(small(twice), at("twice"), "left_semi").dropDuplicates([id_col, text_col]))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and link components of all documents, at four or fewer differing bits."""
    return near_duplicates(documents(spark, sf_dir))
