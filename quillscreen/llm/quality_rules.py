"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules are counted inside each text. The method then hashes every normalised line, counts the documents of a host that
hold it, removes lines held by more than ``max_docs`` documents of the host, and rejects a document that keeps less than
``min_left`` of its words.

A normalised line is lower-cased, its ASCII digits are dropped and its words are joined by one space, so numbered variants of
a footer count as one line. Every line with a word counts, however short.

Defined cases: a null text has no words and fails the base rules; documents without a host share one; a document is an id with
its text, so rows that repeat it count once towards the frequency of a line and each get the same verdict, and rows that share
an id but not the text are told apart; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm.common import BLANKS, cut, documents, join_aggregate, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _covered(at: Column) -> Column:
    """Words covered by windows that start at the sorted positions ``at``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"))
    return F.aggregate(at, zero, step, lambda acc: acc["n"])


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One compact row per document: its base figures and ``lines``, an array of (hash, words) of its normalised lines.

    Each step is a column of its own, because an expression inside a lambda would be evaluated for every element. Equal
    windows are found by sorting (hash, position) pairs, and only in texts whose windows are not all different.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text_of(text_col).alias("t"))
    d = d.withColumn("w", words_of(F.col("t"))).withColumn("raw", F.split("t", "\n", -1))
    d = d.withColumn("full", F.filter("raw", lambda x: F.length(F.translate(x, BLANKS, "")) > 0))
    n = F.size("w")
    win = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)]))
    d = d.withColumn("win", F.when(n > WINDOW, win))
    pairs = F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("pairs", F.when(F.size(F.array_distinct("win")) < F.size("win"), pairs))
    p = F.col("pairs")
    same = F.filter(p, lambda x, i: F.get(p, i - 1)["h"].eqNullSafe(x["h"]) | F.get(p, i + 1)["h"].eqNullSafe(x["h"]))
    d = d.withColumn("at", F.sort_array(F.transform(same, lambda x: x["i"])))
    line = lambda x: words_of(F.lower(F.translate(x, "0123456789", "")))
    d = d.withColumn("lw", F.transform("full", line))
    return d.select(
        "doc_id", "host", n.cast("long").alias("n_words"), F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("at")), F.lit(0)).alias("n_repeat_words"), F.xxhash64("t").alias("text_hash"),
        F.transform("lw", lambda x: F.struct(F.xxhash64(F.array_join(x, " ")).alias("h"), F.size(x).alias("n"))).alias("lines"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, min_left: float = 0.5) -> DataFrame:
    """The base figures with ``base_failed``, ``n_removed_words`` (words on lines above the limit) and ``kept``."""
    rows = cut(base_rules(docs, id_col, text_col, host_col))
    counted = F.filter("lines", lambda x: x["n"] > 0)
    # A null host is an empty one here, told apart by a flag, so that plain equality joins.
    host = [F.coalesce("host", F.lit("")).alias("in_host"), F.col("host").isNull().alias("no_host")]
    at = ["h", "in_host", "no_host"]
    document = F.xxhash64("doc_id", "text_hash").alias("document")
    per_doc = rows.select(*host, document, F.explode(F.array_distinct(F.transform(counted, lambda x: x["h"]))).alias("h"))
    frequent = per_doc.groupBy(*at).agg(F.count_distinct("document").alias("n_docs")).filter(F.col("n_docs") > max_docs).drop("n_docs")
    lines = rows.select("doc_id", "host", "text_hash", *host, F.explode(counted).alias("x")).select("doc_id", "host", "text_hash", "in_host", "no_host", "x.h", "x.n")
    key = ["doc_id", "host", "text_hash"]
    # Rows that agree in the whole key would add up, so the sum is divided by their number below.
    removed = join_aggregate(lines, frequent, at).groupBy(*key).agg(F.sum("n").alias("sum_words"))
    copies = rows.groupBy(*key).agg(F.count("*").alias("n_rows"))
    removed = removed.select(*[F.col(k).alias(f"r_{k}") for k in key], "sum_words")
    same = lambda prefix: F.col("doc_id").eqNullSafe(F.col(f"{prefix}doc_id")) & F.col("host").eqNullSafe(F.col(f"{prefix}host")) & (F.col("text_hash") == F.col(f"{prefix}text_hash"))
    copies = copies.select(*[F.col(k).alias(f"c_{k}") for k in key], "n_rows")
    removed = removed.join(copies, F.col("r_doc_id").eqNullSafe(F.col("c_doc_id")) & F.col("r_host").eqNullSafe(F.col("c_host")) & (F.col("r_text_hash") == F.col("c_text_hash")))
    removed = removed.select("r_doc_id", "r_host", "r_text_hash", (F.col("sum_words") / F.col("n_rows")).cast("long").alias("n_removed_words"))
    out = rows.join(removed, same("r_"), "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_removed_words")) < min_left * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdicts of all documents, with ``source`` as the host."""
    return quality_rules(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS m FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM dup) GROUP BY rid),
ln AS (SELECT rid, doc_id, m, source, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT rid, doc_id, m, source, l, list_filter(string_split_regex(lower(translate(l, '0123456789', '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS nw
       FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lw GROUP BY rid),
k AS (SELECT rid, doc_id, m, source, len(nw) AS n, array_to_string(nw, ' ') AS s FROM lw WHERE len(nw) > 0),
freq AS (SELECT source, s FROM k GROUP BY source, s HAVING count(DISTINCT {'i': doc_id, 'm': m}) > 20),
rem AS (SELECT k.rid, sum(k.n) AS n FROM k JOIN freq f ON k.s = f.s AND k.source IS NOT DISTINCT FROM f.source GROUP BY k.rid),
f AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(rem.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN dl USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN rem USING (rid)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - n_removed_words < 0.5 * n_words) AS kept, n_removed_words FROM g
"""
