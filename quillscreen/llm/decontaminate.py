"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Test items are short and documents may be long, so containment is asked for, not resemblance: the share of the item's distinct
five-word shingles that the document holds. Items are partitioned by their number of shingles into sizes (2^(p-1), 2^p], and
each is sketched by its k smallest shingle hashes, with k = floor((1 - t) * 2^p) + 1 for its partition and the threshold t. A document
that holds a share t of the item misses at most (1 - t) * n of its shingles, so it holds at least one of the sketch:
the search has no false negatives, whatever the length of the document. A document meets the sketches of a partition only if it has as many
shingles as the share t of the partition's smallest item. (A banded MinHash of the documents has none to offer
here: an item of 30 shingles in a document of 20,000 words has a resemblance of 0.0015.) Candidates are then verified
by exact containment of the shingle texts.

Words are lower-cased. Defined cases: null texts and texts under five words have no shingle, so such items match nothing and
such documents are clean; repeated items each match; rows that agree in id and text give each of their pairs once; null ids are
kept; empty tables give no pairs; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm.common import cut, documents, shingle_hashes, shingle_texts, small, text_of, words_of

SIZE, THRESHOLD = 5, 0.8


def item_sketches(items: DataFrame, item_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """``hash, need``: the distinct hashes in the sketches of all items, with the fewest shingles a document may have that holds one of their items.

    That number follows from the partition: its items have over half of its upper size.
    """
    d = items.select(words_of(F.lower(text_of(text_col))).alias("w")).withColumn("h", F.sort_array(F.array_distinct(shingle_hashes("w", size)))).filter("h IS NOT NULL")
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("h"))))
    k = F.floor(F.round((1 - threshold) * upper, 6)).cast("int") + 1
    need = F.ceil(F.round(threshold * (F.floor(upper / 2) + 1), 6)).cast("int")
    return d.select(F.explode(F.slice("h", F.lit(1), k)).alias("hash"), need.alias("need")).groupBy("hash").agg(F.min("need").alias("need"))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash, item_id, n_shingles, n_shared``: every pair with containment of ``threshold`` or more."""
    sketch = cut(item_sketches(items, item_col, item_text_col, size, threshold))
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    probe = d.select("doc_id", F.xxhash64("t").alias("text_hash"), words_of(F.lower("t")).alias("w"))
    probe = probe.select("doc_id", "text_hash", (F.size("w") - size + 1).alias("have"), F.explode(shingle_hashes("w", size)).alias("held"))
    hit = cut(probe.join(small(sketch), (F.col("held") == F.col("hash")) & (F.col("have") >= F.col("need")), "left_semi").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct())
    key = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("t") == F.col("hit_hash"))
    found = d.join(small(hit), key, "left_semi").dropDuplicates(["doc_id", "t"])
    held = found.select("doc_id", F.xxhash64("t").alias("text_hash"), words_of(F.lower("t")).alias("w")).select("doc_id", "text_hash", F.explode(shingle_texts("w", size)).alias("shingle"))
    parts = items.select(F.col(item_col).alias("item_id"), F.monotonically_increasing_id().alias("row"), words_of(F.lower(text_of(item_text_col))).alias("w"))
    parts = parts.withColumn("s", shingle_texts("w", size)).filter("s IS NOT NULL").select("item_id", "row", F.size("s").cast("long").alias("n_shingles"), F.explode("s").alias("shingle"))
    pairs = held.join(small(cut(parts)), "shingle").groupBy("doc_id", "text_hash", "item_id", "row", "n_shingles").agg(F.count("*").alias("n_shared"))
    return pairs.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles") - 1e-9).drop("row")


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = contained_items(docs, items, id_col, text_col).select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    key = F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(text_of(text_col)) == F.col("__bad_hash"))
    return docs.join(small(cut(bad)), key, "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with at least 0.8 of the item's five-word shingles in the document."""
    pairs = contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return pairs.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, coalesce(text, '') AS t FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, t, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, t, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT r, item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT r, item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT r, count(*) AS n_shingles FROM bs GROUP BY r)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (r) GROUP BY doc_id, t, r, item_id, n_shingles HAVING 10 * count(*) >= 8 * n_shingles
"""
