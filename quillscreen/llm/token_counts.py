"""Token counts through a digest cache.

``count_tokens`` joins (content digest, tokenizer digest) to a Parquet cache of stored counts, encodes only the distinct
misses, appends them, and reads every count back from the cache.

Only digests and row keys are shuffled: each missing content is given to one row, and encoded where that row's text lies. Which rows
those are travels as the shorter of two lists, the rows to encode or the contents that most rows holding them must skip. Only if both are too
long to broadcast are the texts shuffled to the rows' list, to the same end.

Defined cases: a null text is the empty text (0 bytes, 0 tokens); repeated rows each get their row; an empty table gives no
rows; extra columns are left out of the result; a null document id stays null. The content is normalised only by turning
null into the empty string, as any other rewriting could change the count the tokenizer gives.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm.common import cut, discard, documents, fits, join_aggregate, shared_dir, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: Texts are encoded in batches of so many characters, which bounds the memory of the encodings.
BATCH_CHARS = 400_000
_loaded: dict[str, object] = {}


def tokenizer_digest(path: str, special_tokens: bool = True) -> str:
    """Version of a tokenizer: the digest of its file and of the way special strings are read."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + (b"|special" if special_tokens else b"|plain")).hexdigest()


def batches(texts: list[str]) -> Iterator[list[str]]:
    """Cut a list into runs of about BATCH_CHARS characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > BATCH_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def counter(path: str, version: str) -> Callable[[list[str]], list[int]]:
    """Function from texts to token counts. The tokenizer's bytes are read here, on the driver, and travel with the task."""
    with open(path, "rb") as f:
        data = f.read()
    kind = os.path.splitext(path)[1]
    if kind not in (".json", ".model"):
        raise ValueError(f"no tokenizer library for {kind!r}")

    def count(texts: list[str]) -> list[int]:
        t = _loaded.get(version)
        if kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            if t is None:
                from tokenizers import Tokenizer

                t = _loaded[version] = Tokenizer.from_str(data.decode())
                t.no_truncation()
                t.no_padding()
            return [len(e) for run in batches(texts) for e in t.encode_batch_fast(run, add_special_tokens=False)]
        if t is None:
            import sentencepiece

            t = _loaded[version] = sentencepiece.SentencePieceProcessor(model_proto=data)
        return [len(e) for run in batches(texts) for e in t.encode(run, num_threads=1)]

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``cache_path`` is a Parquet folder in a store that all executors share; it is created when missing. Only one row per digest is
    encoded; rows that agree in id and text count as one row there and are each encoded.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    count = counter(tokenizer_path, version)
    text = text_of(text_col)
    rows = cut(docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("content")))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key")
    held = rows.groupBy("content").agg(F.min(key).alias("key"), F.count("*").alias("n"))
    cache = _cache(spark, cache_path).filter(F.col("tokenizer") == version)
    held = cut(held.join(cache.select("content", F.lit(True).alias("known")).distinct(), "content", "left"))
    misses = held.filter("known IS NULL").select("content", "key")
    # Contents with one row that misses are encoded without being listed.
    skip = held.filter("known OR n > 1").select("content", F.when(F.col("known").isNull(), F.col("key")).alias("keeper"))
    contents = docs.select(key, F.sha2(text, 256).alias("content"), text.alias("t"))
    if fits(misses):
        chosen = contents.join(F.broadcast(misses), ["content", "key"], "left_semi")
    elif fits(skip):
        listed = F.broadcast(skip.withColumnRenamed("content", "listed"))
        chosen = contents.join(listed, F.col("content") == F.col("listed"), "left").filter("listed IS NULL OR keeper = key").select("content", "t")
    else:
        chosen = contents.join(misses, ["content", "key"], "left_semi")

    def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            yield pd.DataFrame({"content": part["content"], "tokenizer": version, "n_tokens": count(part["t"].tolist())})

    found = chosen.select("content", "t").mapInPandas(encode, CACHE_SCHEMA)
    found.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache_path)
    discard(held)
    known = _cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return join_aggregate(rows, known, ["content"], "left").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where the folder does not exist yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with byte_bpe_50k.json.

    The cache folder is the one in ``spark.quillscreen.tokenCache``; unset, this run starts with an empty one.
    """
    import public_tokenizers

    cache = spark.conf.get("spark.quillscreen.tokenCache", None) or shared_dir(spark)
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), cache)
