"""Removal of long repeated byte strings by a distributed, hash-compared suffix sort.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else in the corpus.

1. Every window of LENGTH bytes has an anchor: its K-byte gram with the smallest hash, the leftmost on ties. Equal windows have their
   anchors at equal offsets, so suffixes that could agree meet under the hash of one gram. Neighbouring windows share anchors,
   so a document is written as *runs* of window starts with one anchor, about one run for (LENGTH - K) / 2 bytes. No text moves.
2. Runs whose gram occurs once repeat nowhere. Runs whose whole context (all bytes of their windows) is the same repeat
   throughout; contexts are compared by a BLAKE2 digest of 128 bits, any number of copies collapses to a count before it is shuffled, and
   the first and the last occurrence of each class are compared on their bytes: a digest that lied ends the job with an error.
3. Only grams with different contexts are left. One context of each kind is cut out of its text and sorted with the others of its
   gram: ``suffix_sort`` has the polynomial hashes, the binary search for common extensions, the mergesort and the
   verification. Grams are dealt into bins of bounded size. The contexts of a gram that does not fit a bin, such as that of a passage many
   documents share, are split as the sort would split them, but over the cluster: by blocks of window starts and the bytes common
   to a block's windows, with equal contexts collapsed on their bytes. Blocks get narrower until the groups fit; groups of one window
   start are single classes.
4. Ranges found are joined back to all runs of the same context, merged per document and cut out.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing; repeated rows are occurrences like any others, so
equal texts of LENGTH bytes or more lose all; overlaps inside a document count; null ids are kept; an empty table gives no rows;
extra columns are ignored; a text of any length is worked on in pieces of PIECE bytes that overlap by a window.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm import suffix_sort
from quillscreen.llm.common import cut, discard, documents, join_aggregate, small, text_of
from quillscreen.llm.suffix_sort import powers, prefix_hashes, repeated_starts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, K = 400, 100
PIECE = 1 << 22
#: Contexts sorted together in one task, and contexts of a group beyond which it is split further.
BIN_CONTEXTS, MAX_CONTEXTS = 2_000, 2_000
#: Window starts in the blocks of each further split.
BLOCKS = (64, 8, 1)
#: Rows that are Python tuples at once.
ROWS = 20_000
RUN = "rid binary, gram long, context binary, start long, stop long, anchor long"


def _digest(b: bytes, *more: int) -> bytes:
    return hashlib.blake2b(struct.pack(f"<{len(more)}q", *more) + b, digest_size=16).digest()


def runs(b: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts [first, last] with their anchor position and the anchor's gram hash."""
    n, w = len(b), length - k + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h, inv = prefix_hashes(b), powers(n)[1]
    gram = (h[k:] - h[:-k]) * inv[: n - k + 1]
    gram ^= gram >> np.uint64(31)
    gram *= suffix_sort.MULT
    gram ^= gram >> np.uint64(29)
    key = (gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(gram), dtype=np.uint64)
    pad = np.full(-len(key) % w, np.uint64(2**64 - 1))
    blocks = np.concatenate([key, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    at = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], starts) - 1
    return first, last, at[first], gram[at[first]].view(np.int64)


def document_runs(text: bytes) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(gram, context, start, stop, anchor) of each run of a text; its windows start at start..stop."""
    b = np.frombuffer(text, np.uint8)
    step = PIECE - LENGTH + 1
    for base in range(0, max(1, len(b) - LENGTH + 1), step):
        part = b[base : base + PIECE]
        for s, e, a, g in zip(*(x.tolist() for x in runs(part)), strict=True):
            s, e, a = s + base, e + base, a + base
            yield g, _digest(text[s : e + LENGTH], a - s, e - s), s, e, a


def _runs_table(docs: DataFrame) -> DataFrame:
    """All runs of ``docs`` (columns rid, t)."""

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["rid", "gram", "context", "start", "stop", "anchor"]
        for part in it:
            rows: list[tuple] = []
            for rid, t in zip(part["rid"], part["t"], strict=True):
                rows += [(rid, *r) for r in document_runs(t.encode())]
                if len(rows) > ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype({c: "int64" for c in names if c not in ("rid", "context")})

    return docs.filter(F.octet_length("t") >= LENGTH).mapInPandas(scan, RUN)


def _verify(docs: DataFrame, classes: DataFrame) -> None:
    """Compare the bytes of the first and the last occurrence (``at``, ``to``) of every class; differing ones raise an error."""
    pair = F.collect_list(F.struct("at.start", "at.stop", F.col("to.start").alias("other")))
    pairs = cut(classes.filter("at <> to").groupBy(F.col("at.rid").alias("rid"), F.col("to.rid").alias("rid2")).agg(pair.alias("pairs")))
    ids = cut(pairs.select("rid").union(pairs.select("rid2")).distinct())
    texts = cut(docs.join(small(ids), "rid", "left_semi").dropDuplicates(["rid"]))
    both = pairs.join(texts, "rid").join(texts.select(F.col("rid").alias("rid2"), F.col("t").alias("t2")), "rid2").select("t", "t2", "pairs")

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            bad = 0
            for t, t2, found in zip(part["t"], part["t2"], part["pairs"], strict=True):
                a, b = t.encode(), t2.encode()
                bad += sum(a[x["start"] : x["stop"] + LENGTH] != b[x["other"] : x["other"] + x["stop"] - x["start"] + LENGTH] for x in found)
            yield pd.DataFrame({"bad": [bad]})

    # Written like all results of Python, as ``cut`` bounds the texts that a worker holds.
    found = cut(both.mapInPandas(compare, "bad long"))
    if found.agg(F.sum("bad")).first()[0]:
        raise RuntimeError("two contexts with one digest differ in their bytes")
    discard(pairs, ids, texts, found)


CONTEXT = "gram long, context binary, n long, low long, high long, body binary"


def _bodies(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """The bytes of one occurrence of each context; ``contexts`` has gram, context, n and ``at`` (rid, start, stop, anchor)."""
    wanted = contexts.groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(F.struct("gram", "context", "n", "at.start", "at.stop", "at.anchor")).alias("want"))
    wanted = cut(wanted)

    def fetch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows: list[tuple] = []
            for t, want in zip(part["t"], part["want"], strict=True):
                b = t.encode()
                for x in want:
                    rows.append((x["gram"], x["context"], x["n"], x["anchor"] - x["stop"], x["anchor"] - x["start"], b[x["start"] : x["stop"] + LENGTH]))
            yield pd.DataFrame(rows, columns=["gram", "context", "n", "low", "high", "body"])

    near = docs.join(small(wanted.select("rid")), "rid", "left_semi")
    once = near.join(wanted, "rid").dropDuplicates(["rid"])
    return cut(once.select("t", "want").mapInPandas(fetch, CONTEXT))


def _sorted_bins(contexts: DataFrame, bins: int) -> DataFrame:
    """``grp, context, low, high``: repeated ranges of d, found by suffix sort in bins of whole groups ``grp``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _, group = np.unique(pdf["grp"].to_numpy(), return_inverse=True)
        found = repeated_starts(group, pdf["body"].tolist(), pdf["low"].to_numpy(), pdf["high"].to_numpy(), pdf["n"].to_numpy() > 1, LENGTH)
        rows = [(g, c, lo, hi) for g, c, f in zip(pdf["grp"], pdf["context"], found, strict=True) for lo, hi in f]
        return pd.DataFrame(rows, columns=["grp", "context", "low", "high"]).astype({"grp": "int64", "low": "int64", "high": "int64"})

    return contexts.groupBy(F.pmod(F.xxhash64("grp"), F.lit(bins))).applyInPandas(one, "grp long, context binary, low long, high long")


def _split(contexts: DataFrame, block: int) -> DataFrame:
    """The parts of ``contexts`` (gram, context, n, low, high, body) in each block of ``block`` window starts.

    ``grp`` is a hash of the gram, the block and the bytes common to all its windows: only parts with one ``grp`` can share a window.
    """
    j = F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block)))
    d = contexts.withColumn("j", j).withColumns({"lo": F.greatest("low", F.col("j") * block), "hi": F.least("high", F.col("j") * block + block - 1)})
    common = F.substring(F.col("body"), (F.col("high") - F.col("j") * block + 1).cast("int"), F.lit(LENGTH - block + 1))
    part = F.substring(F.col("body"), (F.col("high") - F.col("hi") + 1).cast("int"), (F.col("hi") - F.col("lo") + LENGTH).cast("int"))
    return d.select("gram", "context", "n", F.col("lo").alias("low"), F.col("hi").alias("high"), F.xxhash64("gram", "j", common).alias("grp"), part.alias("body"))


def _repeats(contexts: DataFrame, distinct: bool = True, blocks: tuple[int, ...] = BLOCKS) -> list[DataFrame]:
    """Tables ``gram, context, low, high`` with the repeated ranges of d of the contexts with n = 1.

    ``contexts`` has gram, context, n, low, high, body and ``grp``: contexts of different groups share no window. ``distinct`` says that
    all bodies of a group differ.
    """
    key, found = ["grp", "low", "high", "body"], []
    every = cut(contexts)
    classes = every.drop("gram")
    if not distinct:
        # A class of one context is told by that context below; the others repeat throughout and are partners only.
        classes = cut(every.groupBy(*key).agg(F.sum("n").alias("n"), F.min("context").alias("context")))
        told = join_aggregate(every.filter("n = 1"), classes.filter("n > 1").select(*key), key)
        found.append(cut(told.select("gram", "context", "low", "high")))
    sizes = classes.groupBy("grp").agg(F.count("*").alias("members"), F.count_if(F.col("n") == 1).alias("open")).filter("open > 0 AND members > 1")
    sizes = cut(sizes.select("grp", (F.lit(bool(blocks)) & (F.col("members") > MAX_CONTEXTS)).alias("hot")))
    left = classes.join(small(sizes), "grp")
    fit = left.filter("NOT hot")
    ranges = cut(_sorted_bins(fit.drop("hot"), fit.count() // BIN_CONTEXTS + 1))
    of = every.select("grp", "context", "gram")
    found.append(cut(ranges.join(of, ["grp", "context"]).select("gram", "context", "low", "high")))
    if sizes.filter("hot").limit(1).count():
        more = left.filter("hot").drop("hot").join(of, ["grp", "context"]).drop("grp")
        found += _repeats(_split(more, blocks[0]), False, blocks[1:])
    discard(every, sizes, ranges, *([] if distinct else [classes]))
    return found


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``rid, spans``: for each row of ``docs`` (columns rid, t) with repeated bytes, its ranges [start, end), sorted by start."""
    every = cut(_runs_table(docs))
    grams = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).filter("n > 1")
    # A table of its own, so that both sides of the join are plain shuffles and AQE can split a gram with very many runs.
    grams = cut(grams.select("gram", (F.col("a") == F.col("b")).alias("alike")))
    told = cut(every.join(grams, "gram"))
    discard(every, grams)
    place = F.struct("rid", "start", "stop", "anchor")
    classes = cut(told.groupBy("gram", "context", "alike").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.max(place).alias("to")))
    _verify(docs, classes.filter("n > 1").select("at", "to"))
    whole = told.filter("alike").select("rid", "start", "stop")
    mixed = told.filter("NOT alike")
    contexts = classes.filter("NOT alike").select("gram", "context", "n", "at")
    open_ = cut(contexts.groupBy("gram").agg(F.count_if(F.col("n") == 1).alias("open")).filter("open > 0").select("gram"))
    bodies = _bodies(docs, contexts.join(small(open_), "gram"))
    found = _repeats(bodies.withColumn("grp", F.col("gram")))
    ranges = functools.reduce(DataFrame.union, found).groupBy("gram", "context").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    full = contexts.filter("n > 1").select("gram", "context", F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("ranges"))
    verdict = cut(ranges.union(full))
    back = mixed.join(verdict, ["gram", "context"])
    parts = back.filter("ranges IS NULL").select("rid", "start", "stop")
    parts = parts.union(back.filter("ranges IS NOT NULL").select("rid", "anchor", F.explode("ranges").alias("r")).select("rid", F.col("anchor") - F.col("r.high"), F.col("anchor") - F.col("r.low")))
    spans = cut(whole.union(parts).groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("stop") + LENGTH).alias("end")))).alias("spans")))
    discard(told, classes, open_, bodies, verdict, *found)
    return spans


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted ranges with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for x in spans:
        s, e = int(x["start"]), int(x["end"])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def with_row_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    rid = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text)))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), rid.alias("rid"))


REPORT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    docs = with_row_id(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs.select("rid", "t"))
    ids = spans.select("rid")
    clean = docs.join(small(ids), "rid", "left_anti").select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = []
            for t, spans in zip(part["t"], part["spans"], strict=True):
                b, at, keep = t.encode(), 0, hashlib.sha256()
                cuts = merged(spans)
                for s, e in cuts:
                    keep.update(b[at:s])
                    at = e
                keep.update(b[at:])
                rows.append((len(b), sum(e - s for s, e in cuts), len(cuts), keep.hexdigest()))
            got = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"], index=part.index)
            yield pd.concat([part[["doc_id"]], got], axis=1)

    dirty = docs.join(small(ids), "rid", "left_semi").join(spans, "rid").select("doc_id", "t", "spans")
    return clean.union(cut(dirty.mapInPandas(run, f"doc_id {kind}, {REPORT}")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes removed from all documents."""
    return dedup_report(documents(spark, sf_dir))
